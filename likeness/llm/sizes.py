"""Joins by size: what is broadcast, what is shuffled, and keys too hot for a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.plans.staging import stage

# Rows of some 50 bytes.
BROADCAST_ROWS = 1_000_000
# Fewer rows of a key than this are never parted from the others.
HOT_ROWS = 1_000


def small(table: DataFrame, rows: int) -> DataFrame:
    """``table``, of so many narrow rows, to be broadcast if they are few."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def matched(rows: DataFrame, table: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """Join with ``table``, which has each key once and the number ``n`` of its rows.

    A key of more than half of what a task would get does not go through the
    shuffle; there are few of those, so they are broadcast, whatever the size.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(HOT_ROWS, n_rows // (2 * tasks))
    hot = F.broadcast(stage(table.filter(F.col("n") > limit), "hot"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.filter(F.col("n") <= limit), keys)
    return rows.join(hot, keys).unionByName(rest)
