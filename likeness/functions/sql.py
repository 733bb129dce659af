"""The column functions under names that SQL can use.

They are SQL functions, so Catalyst inlines their bodies: no Python worker, and
plans as those of the DataFrame steps. ``prime_minhash`` is a subquery, which
may stand wherever a correlated one may, as in SELECT and WHERE.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from likeness.functions.hashing import BLOCK, PART, PrimeFamily
from likeness.functions.text import SENTENCE_PATTERN, SPLIT_WORDS, STOP_WORDS, URL_PATTERN, USER_PATTERN
from likeness.params import MinHashParams


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shingles(k: str | int) -> str:
    return (
        f"CASE WHEN length(sentence) >= {k} THEN transform(sequence(1, greatest(length(sentence) - {k} + 1, 1)), "
        f"i -> substr(sentence, i, {k})) ELSE CAST(array() AS ARRAY<STRING>) END"
    )


def definitions(params: MinHashParams = MinHashParams()) -> dict[str, str]:
    """``name(parameters) RETURNS type`` and body of each function."""
    heads = "|".join(r"{}(?={}\b)".format(*words.split()) for words in SPLIT_WORDS)
    family = PrimeFamily(params)
    masked = f"regexp_replace(regexp_replace(body, {_literal(URL_PATTERN)}, 'URL'), {_literal(USER_PATTERN)}, 'AT_USER')"
    cleaned = f"lower(regexp_replace({masked}, '[^a-zA-Z]+', ' '))"
    words = f"split(regexp_replace({cleaned}, {_literal(rf'\b({heads})')}, '$1 '), ' +')"
    stop = ", ".join(map(_literal, STOP_WORDS))
    parts = f"SELECT {family.cut('sentence', 'i', PART)} AS part FROM explode({family.starts('sentence', PART)}) AS p(i)"
    blocks = f"SELECT {family.cut('part', 'j', BLOCK)} AS block FROM ({parts}) LATERAL VIEW explode({family.starts('part', BLOCK)}) b AS j"
    names = [f"base{i}" for i in range(BLOCK)]
    bases = ", ".join(f"{x} AS {name}" for x, name in zip(family.bases("block"), names))
    sentences = f"regexp_extract_all(body, {_literal(SENTENCE_PATTERN)}, 0)"
    return {
        # Sentences of a text, as a table for a lateral join and as a list.
        "document_sentences(body STRING) RETURNS TABLE (ord INT, sentence STRING)": f"SELECT pos, col FROM posexplode({sentences})",
        "sentence_list(body STRING) RETURNS ARRAY<STRING>": sentences,
        # Every window of k characters.
        "shingle_list(sentence STRING, k INT) RETURNS ARRAY<STRING>": _shingles("k"),
        # Words of a text without links, users, symbols and stop words.
        "clean_token_list(body STRING) RETURNS ARRAY<STRING>": f"filter({words}, t -> t <> '' AND t NOT IN ({stop}))",
        # One minimum for each function of the prime family. The subquery becomes
        # a grouping by different sentences, which is compiled, and a join.
        "prime_minhash(sentence STRING) RETURNS ARRAY<BIGINT>": (
            f"CASE WHEN length(sentence) >= {params.shingle_len} THEN "
            f"(SELECT {family.minima(names)} FROM (SELECT {bases} FROM ({blocks}))) END"
        ),
        # Mean of vectors of one length, null without any.
        "vector_mean(vectors ARRAY<ARRAY<DOUBLE>>) RETURNS ARRAY<DOUBLE>": (
            "CASE WHEN size(vectors) > 0 THEN transform(aggregate(slice(vectors, 2, size(vectors)), vectors[0], "
            "(total, v) -> zip_with(total, v, (a, b) -> a + b)), x -> x / size(vectors)) END"
        ),
    }


def register(spark: SparkSession, params: MinHashParams = MinHashParams()) -> None:
    """Create the functions in the session; they go with it."""
    for signature, body in definitions(params).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
