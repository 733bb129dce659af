"""Places in a sorted order, without one task that sees the whole order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm.sizes import small
from likeness.plans.staging import shuffle_tasks, stage

# A place within a partition takes 33 bits; partitions are kept far smaller.
_ROW_BITS = (1 << 33) - 1
TASK_ROWS = 5_000_000


def ranked(rows: DataFrame, group: list[str], order: list[str], place: str = "place") -> DataFrame:
    """Add ``place``, 0, 1, ... within ``group`` by ``order``.

    ``group`` and ``order`` together should tell rows apart; equal rows share a
    range and take their places in any order. Writes the rows, for a range sort
    reads its input twice, deals them out in ranges whose number follows theirs,
    and writes them sorted; what goes further is one number for each group and
    range, at most ranges + groups rows.
    """
    by = [*group, *order]
    rows = stage(rows, "unranked")
    tasks = shuffle_tasks(rows.sparkSession, rows.count(), TASK_ROWS)
    sorted_rows = stage(
        rows.repartitionByRange(tasks, *by)
        .sortWithinPartitions(*by)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))),
        "ranked",
    )
    runs = sorted_rows.groupBy(*group, "_range").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n")
    )
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        runs.select(
            *group,
            "_range",
            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
        ),
        "offsets",
    )
    return (
        sorted_rows.join(small(offsets, offsets.count()), [*group, "_range"])
        .withColumn(place, F.col("_at") + F.col("_offset"))
        .drop("_range", "_at", "_offset")
    )
