"""Benchmark decontamination: documents that hold word windows of test items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm import wu_manber as kernel

WINDOW = 13
# Bytes of test items searched for in one pass. Tables take some 200 times
# that in a Python worker; a larger benchmark is searched for in slices.
SLICE_BYTES = 512 << 10

_SPANS = "array<struct<start:bigint,end:bigint>>"
_FOUND = f"struct<n_words:bigint,spans:{_SPANS},item_ids:array<string>>"


def slices(benchmark: DataFrame, item_id: str, text: str, slice_bytes: int):
    """The items in lists of about ``slice_bytes``, one list on the driver at a time."""
    items = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string"))
    held, size = [], 0
    for row in items.toLocalIterator():
        cost = len((row[1] or "").encode()) + 32
        if held and size + cost > slice_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += cost
    yield held


def _searcher(spark, items, window):
    shared = spark.sparkContext.broadcast(kernel.sealed(kernel.Searcher(items, window)))

    def batch(texts):
        return kernel.search_batch(texts, shared)

    return F.arrow_udf(batch, _FOUND)


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` and ``item_ids`` to every row of ``docs``.

    Words are runs of digits, letters a-z after folding A-Z, and characters
    beyond ASCII. A window is ``window`` consecutive words of an item, or all
    words of a shorter one. ``hit_spans`` are the maximal runs ``[start, end)``
    of word numbers inside any occurrence of a window; ``item_ids``, sorted as
    strings, name the items whose windows occur.

    Null and empty texts have no words and no hits, items without words match
    nothing, and an item without an id gives hits but no name. Repeated rows
    each keep their row. Other columns stay, but for the three added here.

    A benchmark of one slice needs no shuffle. Of a larger one, slices are
    broadcast one after the other, each in its own pass; only texts with hits
    are shuffled, by a digest of the text, and joined back.
    """
    spark = docs.sparkSession
    found = slices(benchmark, item_id, item_text, slice_bytes)
    first, second = next(found), next(found, None)
    if second is None:
        hit = docs.withColumn("_found", _searcher(spark, first, window)(F.col(text)))
        return _unpack(hit)
    passes = []
    for items in _chain(first, second, found):
        hit = docs.select(F.col(text)).withColumn(
            "_found", _searcher(spark, items, window)(F.col(text))
        )
        passes.append(
            hit.filter(F.size("_found.spans") > 0)
            .select(F.sha2(F.col(text), 256).alias("_key"), "_found")
            .dropDuplicates(["_key"])
        )
    merge = F.arrow_udf(kernel.merge_batch, _SPANS)
    hits = (
        reduce(DataFrame.unionAll, passes)
        .groupBy("_key")
        .agg(
            F.flatten(F.collect_list("_found.spans")).alias("_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found.item_ids")))).alias("_ids"),
        )
    )
    counted = docs.withColumn("_n", _searcher(spark, [], window)(F.col(text))["n_words"])
    joined = counted.withColumn("_key", F.sha2(F.col(text), 256)).join(hits, "_key", "left")
    spans = F.coalesce(merge(F.col("_spans")), F.array().cast(_SPANS))
    return _unpack(
        joined.withColumn(
            "_found",
            F.struct(
                F.col("_n").alias("n_words"),
                spans.alias("spans"),
                F.coalesce("_ids", F.array().cast("array<string>")).alias("item_ids"),
            ),
        ).drop("_n", "_key", "_spans", "_ids")
    )


def _chain(*parts):
    first, second, rest = parts
    yield first
    yield second
    yield from rest


def _unpack(found: DataFrame) -> DataFrame:
    return found.withColumns(
        {
            "n_words": F.col("_found.n_words"),
            "hit_spans": F.col("_found.spans"),
            "item_ids": F.col("_found.item_ids"),
        }
    ).drop("_found")


def hit_words():
    lengths = F.transform("hit_spans", lambda s: s["end"] - s["start"])
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b)


def contaminated(n_hit, n_words):
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(found: DataFrame) -> DataFrame:
    """The digest form of ``find_items``: one row per document."""
    rows = found.withColumn("n_hit", hit_words())
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
