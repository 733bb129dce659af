"""Transitive clusters: connected components of any shape and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.operators.skew import GROUP_ROWS, hot_routes, lookup_join, route_counts
from likeness.plans.staging import shuffle_partitions, shuffle_tasks, stage

# Nodes with their labels that are broadcast rather than shuffled.
BROADCAST_NODES = 1_000_000


def connected_components(
    edges: DataFrame, group_rows: int = GROUP_ROWS, broadcast_nodes: int = BROADCAST_NODES
) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``: the least node it reaches.

    Direction, loops and repeated edges do not matter; a node with only a loop
    is its own component, edges with a null end are left out, and no edges give
    no rows. Order is that of the ids' type, for text by bytes.

    Links point from a node to a smaller one. In turns, all neighbours larger
    than a node are linked to its least neighbour, and then all smaller ones
    are; every turn keeps what is connected, and a path of n nodes needs some
    log(n) turns. Links are written after each turn, so a lost executor repeats
    one turn. A node with more than ``group_rows`` links is not gathered: its
    least neighbour is found with a map-side combine and goes back to its links
    by broadcast.
    """
    spark = edges.sparkSession
    # Read twice: loops and links; the work above them is done once.
    ends = stage(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst"), "edges")
    loops = ends.filter("src = dst").select(F.col("src").alias("node")).distinct()
    links = stage(_pointed(ends.filter("src <> dst").select("src", "dst")), "links")
    n, mark = links.count(), None
    while True:
        with shuffle_partitions(spark, shuffle_tasks(spark, 2 * n)):
            both = stage(links.select("src", "dst").unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "both_ways")
            high = _least(both, group_rows, broadcast_nodes).filter("dst > src")
            moved = stage(_pointed(high.select(F.col("dst").alias("src"), F.col("least").alias("dst"))), "links")
            low = _least(moved, group_rows, broadcast_nodes)
            links = stage(
                _pointed(
                    low.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionAll(
                        low.select("src", F.col("least").alias("dst"))
                    )
                ),
                "links",
            )
        # Equal counts and sums of hashes: the same links as a turn before.
        n, total = links.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if (n, total) == mark:
            break
        mark = (n, total)
    found = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = links.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = loops.join(found.select("node").unionAll(roots.select("node")), "node", "left_anti")
    return found.unionAll(roots).unionAll(alone.withColumn("component", F.col("node")))


def _pointed(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller end."""
    return (
        links.filter("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )


def _least(links: DataFrame, group_rows: int, broadcast_nodes: int) -> DataFrame:
    """Add ``least``: the smallest of a link's ``src`` and that node's neighbours."""
    labels = stage(
        links.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("least")), "labels"
    )
    if labels.count() <= broadcast_nodes:
        return lookup_join(links, labels, "src", True)
    counts = stage(route_counts(links, ["src"]).filter(F.col("n") > group_rows), "hot_nodes")
    return lookup_join(links, labels, "src", False, hot_routes(counts, group_rows))
