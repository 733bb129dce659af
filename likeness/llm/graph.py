"""Connected components by joins, for graphs of any shape and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.plans.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(src, dst)``: the least node it reaches.

    Alternates large-star and small-star steps, each one aggregation and one
    join on the node, until a round changes nothing. Links are distinct and
    written each round, so lost executors repeat one step. Nulls, loops and
    repeated links do no harm; no links give no rows.
    """
    edges = stage(
        links.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        large = _star(_both_ways(edges), smaller_only=False)
        edges = stage(_star(large, smaller_only=True), "links")
        now = tuple(
            edges.agg(
                F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
            ).first()
        )
        if now == before:
            break
        before = now
    roots = edges.select("dst").distinct().select(F.col("dst").alias("node"), F.col("dst").alias("root"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionAll(roots)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _star(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Link neighbours of each node to the least of them and the node itself.

    Large star (all neighbours known): larger neighbours move to the least one.
    Small star (only smaller neighbours known): all of them, and the node, do.
    """
    least = edges.groupBy("src").agg(F.min("dst").alias("low")).select(
        "src", F.least("src", "low").alias("low")
    )
    joined = edges.join(least, "src")
    if smaller_only:
        moved = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionAll(
            least.select("src", F.col("low").alias("dst"))
        )
    else:
        moved = joined.filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.filter("src <> dst").distinct()
