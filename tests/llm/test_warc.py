import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from likeness.llm import warc
from likeness.plans.staging import fresh_path

BIG = "<p>same page</p>" * 20
PAGES = [
    (4, "http://a/4", BIG),
    (2, "http://a/2", BIG),
    (9, None, BIG),
    (3, "http://a/3", "tiny"),
    (5, "http://a/\r\n5", "tiny"),
    (6, "http://a/6", None),
    (7, "http://a/7", ""),
    (7, "http://a/7", ""),
    (None, "http://a/x", BIG),
    (8, "http://a/8", "é" * 300_000),
    (10, "http://a/10", "head\r\n\r\nbody" * 30),
]


def frame(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumn("refers_to", F.lit(1)).repartition(3)


def archive(spark, rows=PAGES, **options):
    folder = fresh_path(spark, "warc")
    manifest = warc.write(frame(spark, rows), folder, **options)
    return folder.removeprefix("file:"), manifest


def test_round_trip(spark):
    folder, manifest = archive(spark, roll_bytes=300, task_bytes=1_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    rows = warc.read(spark, folder).collect()
    assert len(rows) == len(PAGES)
    texts = {i: h or "" for i, _, h in PAGES}
    for r in rows:
        raw = texts[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        if texts[r.page_id] == BIG and r.page_id != 2:
            assert (r.record_type, r.refers_to) == ("revisit", 2)
        else:
            assert (r.record_type, r.refers_to) == ("response", None)


def test_files_do_not_depend_on_the_run(spark):
    def content():
        folder, _ = archive(spark, roll_bytes=2_000)
        files = sorted(glob.glob(f"{folder}/*.warc.gz"))
        assert not glob.glob(f"{folder}/_temporary/*.gz")
        return [gzip.open(f).read() for f in files]

    assert content() == content()


def test_a_changed_file_is_noticed(spark):
    folder, _ = archive(spark, [(1, "u", "x" * 500)])
    (path,) = glob.glob(f"{folder}/*.warc.gz")
    data = gzip.open(path).read().replace(b"xxx", b"xyx")
    with gzip.open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="does not fit|differs"):
        warc.read(spark, folder).collect()


def test_empty(spark):
    folder, manifest = archive(spark, [])
    assert manifest.count() == 0 and warc.read(spark, folder).count() == 0
