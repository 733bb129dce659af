"""Finding the keys that hold more rows than one task should take.

Hot keys only route rows: a hot key goes through map-side aggregation and a
broadcast, every other key through a shuffle. Both ways give the same rows, so
a key wrongly called hot costs nothing but a little broadcast space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A group of this many rows is still sorted by one task without trouble.
GROUP_ROWS = 1_000_000
# Keys broadcast at most, 16 bytes each. There are total / GROUP_ROWS hot keys
# at most; of more than this the join is left to shuffles.
BROADCAST_KEYS = 1_000_000


def route(*keys: str | Column) -> Column:
    """64-bit routing hash of a key."""
    return F.xxhash64(*keys)


def routed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their ``route``; one that they have stays, and with it how they are laid out."""
    return rows if "route" in rows.columns else rows.withColumn("route", route(*keys))


def route_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(route, n)``: how many rows each routing hash has.

    A plain grouping: tasks add up before they shuffle one narrow row for each
    key, and no task sees more than its share of the keys.
    """
    return routed(rows, keys).groupBy("route").agg(F.count("*").alias("n"))


def hot_routes(counts: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame | None:
    """Routes of ``counts(route, n)`` with more than ``group_rows`` rows; None if none has.

    A lower ``group_rows`` than one task can take may name more routes than are
    broadcast; it is raised then, up to ``GROUP_ROWS``, for a join by shuffle
    would move all rows once more. ``counts`` should be staged: it is read for
    the check and again with the result.
    """
    hot = counts.filter(F.col("n") > group_rows).select("route")
    n = hot.count()
    while n > BROADCAST_KEYS and group_rows < GROUP_ROWS:
        group_rows = min(4 * max(group_rows, 1), GROUP_ROWS)
        hot = counts.filter(F.col("n") > group_rows).select("route")
        n = hot.count()
    return hot if n else None


def few(table: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """A table of narrow rows, to be broadcast if it has no more than ``limit``."""
    return F.broadcast(table) if table.count() <= limit else table


def split_hot(
    rows: DataFrame, keys: list[str], hot: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(rows of hot keys, all other rows)``, both with their ``route``.

    ``hot`` comes from hot_routes.
    """
    own = routed(rows, keys)
    table = few(hot)
    return own.join(table, "route", "left_semi"), own.join(table, "route", "left_anti")


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, fits: bool, hot: DataFrame | None = None
) -> DataFrame:
    """Left join with a table that has each key once.

    ``fits`` says that the caller has checked the table to be small enough to
    broadcast. A larger one is joined by a shuffle, but for the rows of the
    ``hot`` keys: they stay in place and meet a broadcast of just those keys.
    """
    if fits:
        return rows.join(F.broadcast(table), key, "left")
    if hot is None:
        return rows.join(table, key, "left")
    hot_rows, other_rows = (part.drop("route") for part in split_hot(rows, [key], hot))
    hot_table, other_table = (part.drop("route") for part in split_hot(table, [key], hot))
    return hot_rows.join(few(hot_table), key, "left").unionByName(
        other_rows.join(other_table, key, "left")
    )
