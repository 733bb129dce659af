"""Reading lines of which some may be faulty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from likeness.plans.staging import fresh_path
from likeness.sources.text import Lines


@dataclass
class Sorted:
    """Rows of the sound lines; the faulty lines with file and reason; and how many each."""

    rows: DataFrame
    rejected: DataFrame
    n_rows: int
    n_rejected: int


def set_aside(spark: SparkSession, path: str, lines: Lines) -> Sorted:
    """Read ``lines`` from ``path`` without ending at the first faulty one.

    One pass over the files writes both kinds, apart from each other, and
    counts them on the way. The rows are those that the plain reader gives for
    files without the faulty lines. ``rejected`` is ``(file, line, reason)``.
    """
    reason = lines.reason
    parsed = spark.read.text(path).select(
        reason.isNull().alias("sound"),
        F.when(reason.isNull(), F.struct(*lines.columns)).alias("row"),
        F.when(reason.isNotNull(), F.struct(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), reason.alias("reason"))).alias("fault"),
    )
    counts = Observation()
    observed = parsed.observe(
        counts,
        F.count_if("sound").alias("n_rows"),
        F.count_if(~F.col("sound")).alias("n_rejected"),
    )
    target = fresh_path(spark, f"{lines.kind}_lines")
    observed.write.partitionBy("sound").parquet(target)
    # Reading with the schema, for a folder of either kind may be missing.
    written = spark.read.schema(parsed.schema).parquet(target)
    found = counts.get
    return Sorted(
        written.filter("sound").select("row.*"),
        written.filter("NOT sound").select("fault.*"),
        found["n_rows"],
        found["n_rejected"],
    )
