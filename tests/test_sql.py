from helpers import plan_text, rows
from pyspark.sql import functions as F

from likeness.functions.hashing import PrimeFamily
from likeness.functions.sql import register
from likeness.functions.text import clean_tokens, shingle_array
from likeness.operators.sentences import sentences
from likeness.params import MinHashParams

TEXTS = [
    'He said "Stop." Then left. What?! Yes', "no capital here.", "", None, "State's 3.14 \\ back, \"quoted\" end.",
    "See https://a.b/c and @me: I can not, gonna wanna cannot go!", "A" * 87 + ".", "É Ünder. Émile",
]


def test_functions_agree_with_columns(spark):
    register(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = spark.sql("SELECT doc_id, s.ord, s.sentence FROM {docs}, LATERAL document_sentences(text) s", docs=docs)
    assert rows(found) == rows(sentences(docs)) and found.columns == ["doc_id", "ord", "sentence"]
    plan = plan_text(found)
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan.split("== Optimized")[-1]
    params = MinHashParams()
    columns = docs.select(
        "doc_id",
        clean_tokens(F.col("text")).alias("t"),
        shingle_array(F.col("text"), 5).alias("s"),
        PrimeFamily(params).minhash(F.col("text")).alias("m"),
    )
    called = spark.sql(
        "SELECT doc_id, clean_token_list(text) AS t, shingle_list(text, 5) AS s, prime_minhash(text) AS m FROM {docs}", docs=docs
    )
    as_text = lambda df: sorted(map(str, df.collect()))
    assert as_text(called) == as_text(columns)


def test_vector_mean(spark):
    register(spark)
    found = spark.sql(
        "SELECT vector_mean(array(array(1D, 2D), array(3D, 5D))) AS two, vector_mean(array(array(7D))) AS one, "
        "vector_mean(CAST(array() AS ARRAY<ARRAY<DOUBLE>>)) AS none"
    ).first()
    assert (found.two, found.one, found.none) == ([2.0, 3.5], [7.0], None)


def test_prime_minhash_is_compiled(spark):
    """No interpreted lambda; every row has its value, equal ones too; and the function may filter."""
    register(spark)
    texts = [None, "", "A" * 11, *("Né😀 b"[i % 5] * 9 + "xyz" * i for i in range(1, 60)), "xyz" * 30, "xyz" * 30]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    called = spark.sql("SELECT doc_id, text, prime_minhash(text) AS m FROM {docs}", docs=docs)
    plan = plan_text(called)
    assert "lambda" not in plan and "Python" not in plan and "Arrow" not in plan
    columns = docs.select("doc_id", "text", PrimeFamily(MinHashParams()).minhash(F.col("text")).alias("m"))
    as_text = lambda df: sorted(map(str, df.collect()))
    assert as_text(called) == as_text(columns)
    assert spark.sql("SELECT text FROM {docs} WHERE prime_minhash(text) IS NULL", docs=docs).count() == 3
