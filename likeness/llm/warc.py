"""WARC archives: a deterministic sharded writer, and a reader that verifies."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm import warc_kernel as kernel
from likeness.llm.sizes import matched
from likeness.plans.staging import fresh_path, stage

# Compressed bytes at which a file is closed.
ROLL_BYTES = 8 << 20
# Payload bytes meant for one task, several files' worth.
TASK_BYTES = 256 << 20
# Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"

_FILES = "partition bigint, number bigint, temporary string, records bigint, bytes bigint, sha256 string"
_READ = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, url string"
)


def page_rows(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """``(page_id, payload_digest, kind, refers_to, url, html)``: pages and notes on them.

    A page is of kind 1. A note, of kind 0, says that the page of the same id
    and digest is a revisit: of equal payloads of at least 100 bytes, the one
    with the smallest page id is the response that the others refer to. Notes
    let the payloads themselves go through one shuffle only.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.sha2(payload, 256).alias("payload_digest"),
        F.lit(1).alias("kind"),
        F.lit(None).cast("bigint").alias("refers_to"),
        F.col(url).cast("string").alias("url"),
        payload.alias("html"),
    )
    large = rows.filter(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "payload_digest")
    first = stage(
        large.groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL"),
        "copied_payloads",
    )
    n_copied = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    notes = (
        matched(large, first, ["payload_digest"], n_copied)
        .filter("page_id IS NULL OR page_id <> first")
        .select(
            "page_id",
            "payload_digest",
            F.lit(0).alias("kind"),
            F.col("first").alias("refers_to"),
            F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("string").alias("html"),
        )
        .distinct()
    )
    return rows.unionByName(notes)


def write(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    roll_bytes: int = ROLL_BYTES,
    task_bytes: int = TASK_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write every row of ``pages`` as a WARC record below ``folder``.

    The payload is ``html`` in UTF-8, empty for null. Records are range-sorted
    by page id, payload digest and URL, and written by one task for each range;
    a file ends when its compressed size reaches ``roll_bytes``. Headers and digests
    are made anew and hold nothing of the time or place of writing.

    Tasks write under temporary names of their own attempt, so that a lost or
    repeated attempt leaves nothing but files that no manifest names. When all
    are done, the files of the successful attempts are renamed, a step that may
    be repeated, and the manifest is written last: an archive without one is
    not complete. Returns the manifest: one row for each file.

    Rows with equal id and payload are each written; null ids come first and
    are never referred to. No rows give an empty manifest. Other columns are
    not written.
    """
    spark = pages.sparkSession
    rows = page_rows(pages, page_id, url, html)
    size = pages.agg(F.sum(F.octet_length(F.col(html).cast("string")).cast("bigint"))).first()[0] or 0
    tasks = max(1, -(-size // task_bytes), min(spark.sparkContext.defaultParallelism, size >> 20))
    together = ["page_id", "payload_digest"]
    ranged = rows.repartitionByRange(tasks, *together).sortWithinPartitions(*together, "kind", "url")
    write_task = partial(kernel.write_batches, folder=folder, roll_bytes=roll_bytes, date=date)
    written = stage(
        ranged.mapInArrow(write_task, _FILES),
        "warc_files",
    )
    final = F.format_string("part-%06d-%06d.warc.gz", "partition", "number")
    named = written.withColumn("file", final)
    commit = partial(kernel.commit_batches, folder=folder)
    named.select("temporary", "file").mapInArrow(commit, "temporary string, file string").write.format(
        "noop"
    ).mode("overwrite").save()
    manifest = named.select("file", "partition", "number", "records", "bytes", "sha256")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archive in ``folder``, each checked against its digests.

    Files come from the manifest and are checked against it. One row for each
    record: page id, size and digest of the full payload, type, the page that a
    revisit refers to, URL.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    cores = spark.sparkContext.defaultParallelism
    files = manifest.select("file", "sha256").repartition(max(cores, manifest.count()), "file")
    return files.mapInArrow(partial(kernel.read_batches, folder=folder), _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh folder and read the archive back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    write(pages, folder)
    return read(spark, folder).drop("url")
