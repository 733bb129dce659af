import pytest
from pyspark.errors import PySparkException

from likeness.plans.reading import set_aside
from likeness.sources import text as files

KINDS = {
    "vector": (lambda: files.vector_lines(2), ["1,2,0.5,-1e3", "1.0000000000,0,1,2,9"], ["", "1,2", "1,2,0.5", "x,2,1,2", "1,2,1,y", "1,2,,3"]),
    "bucket": (lambda: files.bucket_lines(), ["[1, 2]\t5:0,\tText", "([1],a:b, Text)"], ["", "no bracket", "[1]", "[1]\t5:0"]),
    "edge": (lambda: files.edge_lines(), ["a\tb", "  a b c"], ["", "alone", " alone "]),
    "pair": (lambda: files.pair_lines(), ["3\ta, b"], ["", "3", "x\ta, b", "3\ta,b"]),
    "cluster": (lambda: files.cluster_lines(), ["a\t0\t1\t2\ta, b"], ["", "a\t0\t1\t2", "a\tx\t1\t2\ta, b"]),
    "article": (lambda: files.article_lines(), ["1, text", "only an id", ""], []),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_both_kinds_of_lines(spark, tmp_path, kind):
    make, sound, faulty = KINDS[kind]
    lines = make()
    for name, part in (("sound", sound), ("mixed", sound + faulty), ("faulty", faulty)):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.text(str(tmp_path / name))
    expected = sorted(map(str, files.read(spark, str(tmp_path / "sound"), lines).collect()))
    assert len(expected) == len(sound)
    found = set_aside(spark, str(tmp_path / "mixed"), lines)
    assert (found.n_rows, found.n_rejected) == (len(sound), len(faulty))
    assert sorted(map(str, found.rows.collect())) == expected
    rejected = found.rejected.collect()
    assert sorted(r.line for r in rejected) == sorted(faulty)
    assert all(r.reason and "mixed" in r.file for r in rejected)
    only = set_aside(spark, str(tmp_path / "faulty"), lines)
    assert only.rows.collect() == [] and only.n_rejected == len(faulty)
    for line in faulty:
        path = str(tmp_path / f"one-{faulty.index(line)}")
        spark.createDataFrame([(line,)], "value string").write.text(path)
        with pytest.raises(PySparkException, match=f"not a {kind} line"):
            files.read(spark, path, lines).count()


def test_nothing_to_read(spark, tmp_path):
    spark.createDataFrame([], "value string").write.text(str(tmp_path / "none"))
    found = set_aside(spark, str(tmp_path / "none"), files.edge_lines())
    assert found.rows.collect() == found.rejected.collect() == [] and found.n_rows == found.n_rejected == 0
