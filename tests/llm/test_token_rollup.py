from pyspark.sql import functions as F

from likeness.llm.token_rollup import Rollup, count_tokens
from likeness.plans.staging import fresh_path

SCHEMA = "doc_id long, source string, lang string, text string, sign int, n_tokens int"


def changes(spark, rows, tokenizers=None):
    df = spark.createDataFrame([(i, s, lang, t, sign, 0) for i, (s, lang, t, sign) in enumerate(rows)], SCHEMA)
    return df.withColumn("tokens", count_tokens(F.col("text"), tokenizers))


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_signed_batches_are_idempotent(spark):
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    assert totals(rollup) == {}
    first = changes(spark, [("a", "en", "one two", 1), ("a", "en", "one two", 1), ("a", None, None, 1), (None, "en", "", 1), ("b", "en", "x", None)])
    assert rollup.apply("1", first) and not rollup.apply("1", first)
    expected = {("a", "en", t): (2, 4) for t in ("words-1", "words-2")}
    expected |= {(s, lang, t): (1, 0) for s, lang in (("a", None), (None, "en")) for t in ("words-1", "words-2")}
    assert totals(rollup) == expected
    rollup.compact()
    assert not rollup.apply("1", first) and totals(rollup) == expected
    revised = changes(spark, [("a", "en", "one two", -1), ("a", "en", "one, two, three", 1), ("a", None, None, -1)])
    assert rollup.apply("2", revised)
    expected |= {("a", "en", "words-1"): (2, 5), ("a", "en", "words-2"): (2, 7)}
    expected = {k: v for k, v in expected.items() if k[1] is not None}
    assert totals(rollup) == expected
    rollup.compact()
    assert not rollup.apply("2", revised) and totals(rollup) == expected
    assert rollup.apply("3", first.limit(0)) and totals(rollup) == expected


def test_own_counter(spark):
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    rollup.apply("1", changes(spark, [("a", "en", "é" * 100_000, 1)], {"bytes": F.octet_length}))
    assert totals(rollup) == {("a", "en", "bytes"): (1, 200_000)}
