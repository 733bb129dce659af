"""Exact similarity of the sentences that a bucket brings together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.text import sentence_id, shingle_array
from likeness.operators.skew import GROUP_ROWS, hot_routes, lookup_join, route_counts
from likeness.plans.minhash import BucketJob
from likeness.plans.staging import shuffle_partitions, shuffle_tasks, stage

THRESHOLD = 0.8
# Prefixes or texts that are broadcast rather than shuffled, some KB each.
BROADCAST_ROWS = 20_000


def verified_pairs(
    job: BucketJob, threshold: float = THRESHOLD, group_rows: int = GROUP_ROWS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``(src, dst, shared, total, jaccard)``: members of buckets that resemble their hub.

    ``src`` is the hub of a bucket, ``dst`` another member of it; ``shared`` and
    ``total`` count their common and all distinct shingles. Pairs of a Jaccard
    similarity under ``threshold`` are left out, every other one comes once, in
    however many buckets it meets. As pairs are hub and member, there are fewer
    than members, whatever a bucket holds.

    A pair goes through ever dearer tests, each of which only drops pairs that
    cannot pass. Equal texts are told by a digest. The numbers of shingles may
    differ by the threshold at most. The rarest shingles of both, as many as
    the threshold leaves open, must have one in common. Only then texts are
    fetched and compared, every two different texts once. Hubs of more than
    ``group_rows`` pairs are not shuffled to.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0, and 1 at most")
    spark = job.vectors.sparkSession
    pairs = stage(job.places().filter("row <> hub_row").select("hub_row", "row").distinct(), "hub_pairs")
    n = pairs.count()
    with shuffle_partitions(spark, shuffle_tasks(spark, n)):
        either = pairs.select("row").unionAll(pairs.select(F.col("hub_row").alias("row"))).distinct()
        texts = stage(
            job.vectors.join(either, "row", "left_semi").select(
                "row",
                sentence_id(F.col("doc_id"), F.col("ord")).alias("sid"),
                F.md5("sentence").alias("key"),
                F.size(F.array_distinct(_shingles(job))).alias("n"),
                "sentence",
            ),
            "pair_texts",
        )
        named = texts.drop("sentence")
        fits = named.count() <= broadcast_rows
        both = stage(
            _with_both(pairs, named, "row", fits, _hot(pairs, "hub_row", group_rows))
            .filter(F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n"))
            .drop("row", "hub_row"),
            "named_pairs",
        )
        kinds = stage(both.filter("key <> hub_key").select("key", "hub_key").distinct(), "text_pairs")
        hot = _hot(kinds, "hub_key", group_rows)
        sets = stage(
            texts.join(kinds.select("key").unionAll(kinds.select(F.col("hub_key").alias("key"))).distinct(), "key", "left_semi")
            .dropDuplicates(["key"])
            .select("key", "n", F.array_distinct(_shingles(job)).alias("shingles")),
            "shingle_sets",
        )
        near = stage(
            _with_both(kinds, _prefixes(sets, threshold), "key", fits, hot)
            .filter(F.arrays_overlap("prefix", "hub_prefix"))
            .select("key", "hub_key"),
            "near_pairs",
        )
        shared = F.size(F.array_intersect("shingles", "hub_shingles"))
        compared = stage(
            _with_both(near, sets.drop("n"), "key", fits, hot).select(
                "key", "hub_key", shared.alias("shared"), (F.size("shingles") + F.size("hub_shingles")).alias("total")
            ).withColumn("total", F.col("total") - F.col("shared")),
            "compared",
        )
        equal = both.filter("key = hub_key").withColumns({"shared": F.col("n"), "total": F.col("n")})
        found = equal.unionByName(both.join(compared, ["key", "hub_key"]))
        return stage(
            found.select(F.col("hub_sid").alias("src"), F.col("sid").alias("dst"), "shared", "total")
            .withColumn("jaccard", F.col("shared") / F.col("total"))
            .filter(F.col("jaccard") >= threshold),
            "verified",
        )


def _shingles(job: BucketJob) -> Column:
    return shingle_array(F.col("sentence"), job.params.shingle_len)


def _hot(pairs: DataFrame, key: str, group_rows: int) -> DataFrame | None:
    counts = stage(route_counts(pairs, [key]).filter(F.col("n") > group_rows), "hot_hubs")
    return hot_routes(counts, group_rows)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``(key, prefix)``: the rarest shingles of a set of n, n - ceil(threshold * n) + 1 of them.

    Two sets that share the threshold's part of all share one of these, for all
    sets are in one order: by how many sets have a shingle, then its hash. The
    hash stands for the shingle; a clash lets a pair through to the comparison.
    """
    hashed = sets.select("key", "n", F.explode(F.transform("shingles", lambda s: F.xxhash64(s))).alias("h"))
    uses = stage(hashed.groupBy("h").agg(F.count("*").alias("uses")).filter("uses > 1"), "shingle_uses")
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    return stage(
        hashed.join(uses, "h", "left")
        .groupBy("key", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(1)).alias("uses"), "h"))).alias("ordered"))
        .select("key", F.slice(F.col("ordered.h"), F.lit(1), keep).alias("prefix")),
        "prefixes",
    )


def _with_both(pairs: DataFrame, table: DataFrame, key: str, fits: bool, hot: DataFrame | None) -> DataFrame:
    """Columns of a member, and of its hub as ``hub_...``."""
    hubs = table.select(*(F.col(c).alias(f"hub_{c}") for c in table.columns))
    return lookup_join(lookup_join(pairs, table, key, fits), hubs, f"hub_{key}", fits, hot)
