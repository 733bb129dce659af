import pytest
from helpers import rows
from pyspark.sql import functions as F

from likeness.functions.text import clean_tokens, sentence_array, shingle_array
from likeness.operators.sentences import candidates, length_filter, sentences, shingle_counts
from likeness.params import MinHashParams

# Fixed value: the sentence pattern with greedy quantifiers.
GREEDY = r"""[\s]*([A-Z"][^.!?]*(?:[.!?](?!['"]?\s|$)[^.!?]*)*[.!?]?['"]?)\s*$?"""

CASES = {
    "": [],
    "no capital here. none.": [],
    "Pi is 3.14 today. Next one!": ["Pi is 3.14 today.", "Next one!"],
    "lead in Foo bar. and the Baz qux.": ["Foo bar.", "Baz qux."],
    'He said "Stop." Then left.': ['He said "Stop."', "Then left."],
    "What?! Yes": ["What?!", "Yes"],
    "A. B": ["A.", "B"],
    "Foo\nBar. Baz": ["Foo\nBar.", "Baz"],
    "État neuf. Le Roi.": ["Le Roi."],
    "End.": ["End."],
    'He said "Go."': ['He said "Go."'],
    "Tail here   ": ["Tail here   "],
}


def test_sentence_cases(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    found = dict(df.select("text", sentence_array(F.col("text"))).collect())
    assert found == CASES


def test_possessive_pattern_finds_what_the_greedy_one_finds(documents):
    greedy = documents.select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(GREEDY), F.lit(1)))
    )
    assert rows(sentences(documents)) == rows(greedy)


def test_many_inner_marks_need_no_stack(spark):
    text = "A" + ".b" * 200_000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert sentences(df).select(F.length("sentence")).collect()[0][0] == len(text)


def test_ordinal_counts_dropped_sentences(spark):
    long = "L" + "x" * 120 + "."
    df = spark.createDataFrame([(7, f"Short. {long} Short again.")], "doc_id bigint, text string")
    assert rows(candidates(df, MinHashParams())) == {(7, 1, long): 1}


@pytest.mark.parametrize("length,kept", [(86, False), (87, True), (610, True), (611, False)])
def test_length_bounds_are_strict(spark, length, kept):
    df = spark.createDataFrame([(1, 0, "S" * length)], "doc_id bigint, ord int, sentence string")
    assert length_filter(df, MinHashParams()).count() == int(kept)


def test_shingles(spark):
    df = spark.createDataFrame(
        [(1, 0, "abcabc"), (1, 1, "ab"), (1, 2, "é😀ab")], "doc_id bigint, ord int, sentence string"
    )
    found = [r[0] for r in df.orderBy("ord").select(shingle_array(F.col("sentence"), 3)).collect()]
    assert found == [["abc", "bca", "cab", "abc"], [], ["é😀a", "😀ab"]]
    params = MinHashParams(shingle_len=3)
    assert rows(shingle_counts(df, params)) == {(1, 0, 4, 3): 1, (1, 1, 0, 0): 1, (1, 2, 2, 2): 1}


TOKENS = {
    "See www.example.com/a?b=1 and https://x.org now": ["see", "url", "url"],
    "Mail @Bob_1, thanks": ["mail", "user", "thanks"],
    "The the cats; CATS #tag it's don't": ["cats", "cats", "tag"],
    "I cannot gonna wanna": ["gon", "na", "wan", "na"],
    "Café 12 a#b": ["caf", "b"],
    "no break www.a b": ["break", "url", "b"],
    "": [],
    "the of and": [],
}


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TOKENS], "text string")
    assert dict(df.select("text", clean_tokens(F.col("text"))).collect()) == TOKENS
