"""Signatures kept from batch to batch, laid out so that old ones are never shuffled again."""

from __future__ import annotations

import uuid
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.operators import buckets as B
from likeness.operators.minhash import signatures
from likeness.operators.skew import GROUP_ROWS, hot_routes, route_counts, routed
from likeness.params import MinHashParams
from likeness.plans.minhash import minhash_vectors
from likeness.plans.staging import stage, staging

SLICES = 200
# Signatures of the first batch that a slice may hold.
SLICE_ROWS = 1_000_000
_COLUMNS = "draw INT, sig ARRAY<BIGINT>, doc_id {id}, ord INT, route BIGINT"


class SignatureStore:
    """Signatures of batches of documents in ``folder``.

    Each batch is written once, cut into slices by the routing hash of its
    signatures and sorted in them, and committed by its success file: a batch
    that is sent again, or whose first writing failed, does no harm. All
    batches have the same cut, so that buckets over all of them are found slice
    by slice: only the new batch has been shuffled, at its writing.

    The first batch settles the cut, for good: ``slices``, or more if one of
    them would hold over ``slice_rows`` of its signatures. A file beside the
    batches keeps the number. ``doc_id`` is of one type in all batches, and
    unique over them; the parameters are those of the first batch.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        params: MinHashParams = MinHashParams(),
        slices: int = SLICES,
        id_type: str = "BIGINT",
        slice_rows: int = SLICE_ROWS,
    ):
        self.slice_rows = slice_rows
        self.spark, self.folder, self.params, self.slices = spark, folder.rstrip("/"), params, slices
        self.columns = _COLUMNS.format(id=id_type)
        self.id_type = id_type
        self.tables: list[str] = []

    def add(self, batch: str, documents: DataFrame) -> bool:
        """Write the signatures of ``documents``; False if the batch is there already."""
        if batch in self.batches():
            return False
        table = f"likeness_{uuid.uuid4().hex}"
        with staging(self.spark):
            # Written first, to be counted before it is cut.
            vectors = stage(minhash_vectors(documents, self.params).drop("sentence"), "minhash")
            rows = signatures(vectors, self.params).select("draw", "sig", F.col("doc_id").cast(self.id_type), "ord")
            slices = self.cut(vectors.count() * self.params.draws)
            (
                routed(rows, B.KEYS)
                .repartition(slices, "route")
                .write.bucketBy(slices, "route")
                .sortBy("route")
                .mode("overwrite")
                .option("path", f"{self.folder}/{batch}")
                .saveAsTable(table)
            )
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        return True

    def cut(self, rows: int | None = None) -> int:
        """Number of slices of all batches; with ``rows`` of a first one it is settled, if it is not yet.

        The file is made by its first writer alone, so of two first batches at
        once one goes by the other's number. A folder with batches and without
        the file is cut by ``slices``.
        """
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_slices")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            if rows is None:
                return self.slices
            wanted = self.slices if self.batches() else max(self.slices, -(-rows // self.slice_rows))
            with suppress(Py4JJavaError):  # another writer was first
                made = system.create(path, False)
                made.writeInt(wanted)
                made.close()
        held = system.open(path)
        try:
            return held.readInt()
        finally:
            held.close()

    def batches(self) -> list[str]:
        """Names of the batches that are complete."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = [status.getPath() for status in system.listStatus(path)]
        success = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName() for p in found if system.exists(success(p, "_SUCCESS")))

    def rows(self) -> DataFrame:
        """``(draw, sig, doc_id, ord, route)`` of all batches; a task reads one slice of all of them.

        One table with a partition for each batch: a union of tables would not
        bring their slices together.
        """
        table = f"likeness_{uuid.uuid4().hex}"
        self.tables.append(table)
        self.spark.sql(
            f"CREATE TABLE {table} ({self.columns}, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (route) SORTED BY (route) INTO {self.cut()} BUCKETS LOCATION '{self.folder}'"
        )
        for batch in self.batches():
            self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (batch='{batch}') LOCATION '{self.folder}/{batch}'")
        return self.spark.table(table).drop("batch")

    def close(self) -> None:
        """Take the names of the tables that ``rows`` made from the catalog; their frames end with them."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()

    def members(self, group_rows: int = GROUP_ROWS) -> DataFrame:
        """Members of every bucket of two or more sentences, over all batches.

        As ``BucketJob.members``, hot signatures by a map-side combine.
        """
        rows = self.rows()
        counts = stage(route_counts(rows, B.KEYS).filter(F.col("n") > group_rows), "hot_routes")
        return B.bucket_members(rows, hot_routes(counts, group_rows))
