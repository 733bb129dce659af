import pytest
from helpers import plan_text, rows

from likeness.params import MinHashParams
from likeness.plans.minhash import BucketJob
from likeness.plans.store import SignatureStore

COLUMNS = ("draw", "sig", "doc_id", "ord", "bucket_size", "hub_doc", "hub_ord")


def hashable(df):
    return rows(df.withColumn("sig", df["sig"].cast("string")), *COLUMNS)


@pytest.fixture
def store(spark, tmp_path):
    made = SignatureStore(spark, str(tmp_path / "signatures"), MinHashParams(draws=4), slices=3)
    yield made
    made.close()


@pytest.mark.parametrize("group_rows", [1_000_000, 5])
def test_batches_give_what_one_run_gives(spark, documents, store, group_rows):
    old, new = documents.filter("doc_id < 120"), documents.filter("doc_id >= 120")
    assert store.add("old", old) and store.add("new", new)
    assert not store.add("old", new) and store.batches() == ["new", "old"]
    expected = hashable(BucketJob(documents, MinHashParams(draws=4)).members())
    assert expected and hashable(store.members(group_rows)) == expected
    # A store opened later reads the same.
    later = SignatureStore(spark, store.folder, store.params, store.slices)
    assert hashable(later.members(group_rows)) == expected
    later.close()


def test_no_batch_is_shuffled_again(documents, store):
    store.add("old", documents.filter("doc_id < 120"))
    store.add("new", documents.filter("doc_id >= 120"))
    plan = plan_text(store.members()).split("== Physical")[-1]
    assert "Window" in plan and "Exchange" not in plan and "Bucketed: true" in plan


def test_a_broken_batch_does_not_count(documents, store, tmp_path):
    store.add("old", documents)
    (tmp_path / "signatures" / "half").mkdir()
    (tmp_path / "signatures" / "half" / "part-0.parquet").write_text("x")
    assert store.batches() == ["old"] and store.members().count() > 0


def test_empty_store(store, documents):
    assert store.batches() == [] and store.members().collect() == []
    assert store.add("none", documents.limit(0)) and store.members().collect() == []


def test_a_large_first_batch_takes_more_slices(spark, documents, tmp_path):
    params = MinHashParams(draws=4)
    made = SignatureStore(spark, str(tmp_path / "s"), params, slices=2, slice_rows=500)
    assert made.cut() == 2
    made.add("old", documents.filter("doc_id < 120"))
    first = spark.read.parquet(f"{made.folder}/old").count()
    assert first > 1000 and made.cut() == -(-first // 500)
    made.add("new", documents.filter("doc_id >= 120"))
    later = SignatureStore(spark, made.folder, params, slices=2)
    assert later.cut() == made.cut() and later.batches() == ["new", "old"]
    plan = plan_text(later.members()).split("== Physical")[-1]
    assert "Exchange" not in plan and f"SelectedBucketsCount: {made.cut()} out of {made.cut()}" in plan
    assert hashable(later.members()) == hashable(BucketJob(documents, params).members())
    later.close()
