"""Writing an intermediate result once, where every executor can read it."""

from __future__ import annotations

import copy
import functools
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

_CHECKPOINTS = "spark.checkpoint.dir"
_WAREHOUSE = "spark.sql.warehouse.dir"
# Rows of a few dozen bytes that one shuffle task sorts with ease.
TASK_ROWS = 5_000_000

# Folders made inside the innermost scope. A thread begins without one, so jobs
# in two threads never delete each other's files.
_scope: ContextVar[list[str] | None] = ContextVar("likeness_staged", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, else one in the warehouse."""
    named = spark.conf.get(_CHECKPOINTS, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get(_WAREHOUSE, None)
    if not warehouse:
        raise ValueError(f"set {_CHECKPOINTS} to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_likeness_staging"


def fresh_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark)}/likeness-{uuid.uuid4().hex}"
    folders = _scope.get()
    if folders is not None:
        folders.append(folder)
    return f"{folder}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def content_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path, which may be a pattern."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(target) or []
    return sum(system.getContentSummary(status.getPath()).getLength() for status in found)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside.

    For jobs that have written their results by then: frames that still read
    staged files cannot be used afterwards.
    """
    folders: list[str] = []
    token = _scope.set(folders)
    try:
        yield
    finally:
        _scope.reset(token)
        for folder in folders:
            delete(spark, folder)


def leased(job: Callable) -> Callable:
    """Make a job's staged files live as long as the frame it returns.

    The first argument of ``job`` is the session, frames may follow. All frames
    inside, and all that are derived from the result later, hold one copy of
    the session object; when the last of them is gone, a thread deletes what
    was staged. A frame that only joins with the result does not hold it.
    """

    @functools.wraps(job)
    def run(spark: SparkSession, *args, **options):
        lease = copy.copy(spark)
        folders: list[str] = []
        token = _scope.set(folders)
        try:
            result = job(lease, *(_held_by(lease, a) for a in args), **options)
        finally:
            _scope.reset(token)
            # Not at exit: the JVM may have gone by then.
            weakref.finalize(lease, _delete_later, spark, folders).atexit = False
        return result

    return run


def _held_by(lease: SparkSession, value):
    return ClassicFrame(value._jdf, lease) if isinstance(value, ClassicFrame) else value


def _delete_later(spark: SparkSession, folders: list[str]) -> None:
    """A collector may call this amid a call to the JVM, so another thread deletes."""

    def work():
        for folder in folders:
            with suppress(Exception):  # the session may have ended
                delete(spark, folder)

    if folders:
        threading.Thread(target=work, daemon=True).start()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet and return a scan of it.

    Cuts the lineage, so that a lost executor repeats reads and not the work
    above them, and gives later steps column pruning and exact row counts.
    The returned frame reads the files lazily: they stay until the end of the
    ``staging`` block or the ``leased`` job around, or else until the folder's
    own retention takes them.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Share rows out when a file scan has fewer partitions than there are cores.

    For plain scans only: asking a frame with shuffles for its partitions would
    run them. A large input has more partitions than cores and passes through.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def shuffle_tasks(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS) -> int:
    """Partitions for a shuffle of so many rows, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))


@contextmanager
def shuffle_partitions(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Run what is inside with so many shuffle partitions."""
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    if partitions is not None:
        spark.conf.set(setting, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


_CODEC = "spark.sql.parquet.compression.codec"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Stage what is staged inside in little space, without the shuffle files once it is written."""
    before = {key: spark.conf.get(key, None) for key in (_CODEC, _CLEANUP)}
    spark.conf.set(_CODEC, "zstd")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
