import gc
import threading
import time

import numpy as np
import pyarrow as pa
import pytest

from likeness.functions import kernels
from likeness.plans import staging


def folder_of(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging.shared_folder(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return lambda: {s.getPath().getName() for s in system.listStatus(path)} if system.exists(path) else set()


def gone(listing, before):
    for _ in range(100):
        gc.collect()
        if listing() <= before:
            return True
        time.sleep(0.1)
    return False


def test_files_live_as_long_as_the_frame(spark):
    listing = folder_of(spark)
    before = listing()

    @staging.leased
    def job(spark, rows, scale):
        once = staging.stage(rows, "once")
        return staging.stage(once.join(once.withColumnRenamed("id", "other"), once["id"] > 3), "twice").filter(f"id < {scale}")

    derived = job(spark, spark.range(10), 8).groupBy("id").count().filter("count > 0")
    gc.collect()
    time.sleep(0.5)
    assert len(listing() - before) == 2
    assert derived.count() == 4
    del derived
    assert gone(listing, before)


def test_failed_jobs_leave_nothing(spark):
    listing = folder_of(spark)
    before = listing()

    @staging.leased
    def job(spark):
        staging.stage(spark.range(3), "part")
        raise KeyError("stopped")

    with pytest.raises(KeyError):
        job(spark)
    assert gone(listing, before)


def test_jobs_inside_jobs(spark):
    listing = folder_of(spark)
    before = listing()
    inner = staging.leased(lambda spark, rows: staging.stage(rows, "inner").filter("id > 1"))

    @staging.leased
    def outer(spark):
        return staging.stage(inner(spark, spark.range(5)), "outer")

    rows = outer(spark)
    gc.collect()
    assert rows.count() == 3
    del rows
    assert gone(listing, before)


def test_threads_keep_their_own_files(spark):
    first_open, second_done, found = threading.Event(), threading.Event(), []

    def first():
        with staging.staging(spark):
            first_open.set()
            second_done.wait(60)

    def second():
        first_open.wait(60)
        found.append(staging.stage(spark.range(4), "kept"))
        second_done.set()

    threads = [threading.Thread(target=t) for t in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found[0].count() == 4


def test_vectors_of_wrong_length():
    """One too short and one too long by as much do not make up for each other."""
    planes = np.ones((64, 10))
    with pytest.raises(ValueError):
        kernels.sign_words_batch(pa.array([[1.0] * 63, [1.0] * 65]), planes, 1)
    assert len(kernels.sign_words_batch(pa.array([[1.0] * 64] * 2), planes, 1)) == 2


def test_tidy_leaves_no_shuffle_files(spark):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before, setting = kept(), spark.conf.get("spark.sql.parquet.compression.codec")
    with staging.tidy(spark):
        assert staging.stage(spark.range(1000).repartition(7), "tidy").count() == 1000
    for _ in range(100):
        if kept() <= before:
            break
        time.sleep(0.1)
    assert kept() <= before and spark.conf.get("spark.sql.parquet.compression.codec") == setting
