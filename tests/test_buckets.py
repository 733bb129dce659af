import random

import pytest
from helpers import plan_text, rows
from pyspark.sql import functions as F

from likeness.operators import buckets as B
from likeness.operators import skew
from likeness.operators.minhash import signatures, with_minhash
from likeness.operators.skew import hot_routes, route, route_counts
from likeness.params import MinHashParams
from likeness.plans import minhash
from likeness.plans.minhash import BucketJob, clusters

SIGS = "draw int, sig array<bigint>, doc_id bigint, ord int"


def brute_members(signature_rows):
    groups = {}
    for r in signature_rows:
        groups.setdefault((r[0], tuple(r[1])), []).append((r[2], r[3]))
    return {
        (draw, sig, doc, ord_, len(ids), *min(ids))
        for (draw, sig), ids in groups.items()
        if len(ids) > 1
        for doc, ord_ in ids
    }


def as_set(members):
    found = members.select("draw", "sig", "doc_id", "ord", "bucket_size", "hub_doc", "hub_ord")
    listed = [(r[0], tuple(r[1]), *r[2:]) for r in found.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows share one signature, some more share a few."""
    rng = random.Random(11)
    data = [(rng.randrange(2), [5, 5], d, rng.randrange(3)) for d in range(400)]
    data += [(0, [rng.randrange(40), 1], d, 7) for d in range(400)]
    data += [(1, [d, 2], d, 8) for d in range(400)]
    return data


def test_buckets_of_one_are_dropped(spark):
    data = [(0, [1, 2], 1, 0), (0, [1, 3], 1, 0), (0, [1, 3], 2, 0), (0, [1, 3], 2, 1), (1, [1, 2], 5, 0)]
    df = spark.createDataFrame(data, SIGS)
    assert as_set(B.bucket_members(df)) == brute_members(data)
    assert rows(B.bucket_sizes(df).select("draw", "bucket_size")) == {(0, 3): 1}


def hot_keys(df, group_rows):
    return hot_routes(route_counts(df, B.KEYS), group_rows)


def test_hot_buckets_give_the_same_rows(spark, skewed):
    df = spark.createDataFrame(skewed, SIGS)
    hot = hot_keys(df, 100)
    big = df.filter("sig[0] = 5 and sig[1] = 5").select(route(*B.KEYS)).distinct()
    assert rows(hot) == rows(big)
    members = B.bucket_members(df, hot, tasks=7)
    assert as_set(members) == as_set(B.bucket_members(df)) == brute_members(skewed)


def test_counts_meet_in_no_single_task(spark, skewed):
    df = spark.createDataFrame(skewed, SIGS).repartition(16)
    counts = route_counts(df, B.KEYS)
    plan = plan_text(counts)
    assert "SinglePartition" not in plan and "partial_count" in plan
    assert counts.count() == len({(r[0], tuple(r[1])) for r in skewed})


def test_hot_bucket_rows_are_not_shuffled(spark, skewed):
    """Every shuffle of the hot plan carries sums of it, or rows without hot keys."""
    df = spark.createDataFrame(skewed, SIGS)
    found = B.bucket_members(df, hot_keys(df, 100))
    lines = plan_text(found).split("== Physical Plan ==")[1].splitlines()
    for number, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = line.index("Exchange")
            below = [x for x in lines[number + 1 :]]
            end = next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :|+-")) <= depth - 3), len(below))
            under = "\n".join(below[:end])
            assert "partial_" in under or "LeftAnti" in under


def test_small_inputs_have_no_hot_keys(spark):
    df = spark.createDataFrame([(0, [1], 1, 0)], SIGS)
    assert hot_keys(df, 1) is None


def test_rows_of_buckets_of_one_stay_out(spark, skewed):
    df = spark.createDataFrame(skewed, SIGS)
    shared = route_counts(df, B.KEYS).filter("n > 1").select("route")
    kept = B.shared_rows(df, shared)
    assert kept.count() < df.count() and as_set(B.bucket_members(kept)) == brute_members(skewed)


def test_repeated_document_ids(spark):
    text = "This very same sentence turns up in several documents of the corpus, word for word, again and again."
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    assert BucketJob(docs).member_sentences().count() == 30


def test_any_false_alarm_is_harmless(spark, skewed):
    df = spark.createDataFrame(skewed, SIGS)
    every_route = df.select(route(*B.KEYS).alias("route")).distinct()
    assert as_set(B.bucket_members(df, every_route)) == brute_members(skewed)


def test_copies_share_every_draw_and_no_one_meets_itself(spark):
    text = "This very same sentence turns up in several documents of the corpus, word for word, again and again."
    docs = spark.createDataFrame([(d, text) for d in range(5)], "doc_id bigint, text string")
    members = BucketJob(docs).members()
    assert rows(members, "doc_id", "ord") == {(d, 0): 10 for d in range(5)}
    assert rows(members.select("bucket_size", "hub_doc")) == {(5, 0): 50}


def test_job_matches_hot_job_and_is_independent_of_partitions(spark, documents):
    plain = BucketJob(documents)
    hot = BucketJob(documents, group_rows=20)
    expected = as_set(plain.members())
    assert expected and as_set(hot.members()) == expected
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert as_set(BucketJob(documents.repartition(7)).members()) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bucket_shuffle_leaves_text_behind(documents):
    job = BucketJob(documents)
    scan = [line for line in plan_text(job.members()).splitlines() if "ReadSchema" in line]
    assert scan and all("sentence" not in line for line in scan)


@pytest.mark.parametrize(
    "limits", [{}, {"broadcast_nodes": 0}, {"broadcast_nodes": 0, "group_rows": 30}]
)
def test_clusters_in_parts_hold_the_same_members(documents, limits):
    edges = BucketJob(documents).edges()
    assert rows(edges) == rows(edges.select("dst", "src"))
    whole = {(r["node"], r["size"], r["members"]) for r in clusters(edges).collect()}
    parts = {}
    for r in clusters(edges, max_neighbours=1, **limits).collect():
        parts.setdefault((r["node"], r["size"]), []).append(r)
    assert max(len(p) for p in parts.values()) > 1
    for found in parts.values():
        assert sorted(r["part"] for r in found) == list(range(found[0]["parts"]))
    assert whole == {
        (node, size, ", ".join(sorted(m for r in p for m in r["members"].split(", ") if m)))
        for (node, size), p in parts.items()
    }


def test_signature_equality_needs_all_values(spark):
    params = MinHashParams(num_hashes=3, draws=2, sig_len=2, min_shingles=0)
    df = spark.createDataFrame(
        [(1, 0, "abcdefghijklmnop"), (2, 0, "abcdefghijklmnop"), (3, 0, "zyxwvutsrqponmlk")],
        "doc_id bigint, ord int, sentence string",
    )
    found = B.bucket_members(signatures(with_minhash(df, params), params))
    assert rows(found.select("doc_id").distinct()) == {(1,): 1, (2,): 1}
    assert found.filter(F.col("bucket_size") != 2).count() == 0


def test_no_shuffle_of_buckets_carries_signatures(documents):
    """Two longs stand for a signature until members have been found."""
    for group_rows in (1_000_000, 20):
        plan = plan_text(BucketJob(documents, group_rows=group_rows).places())
        assert "mark" in plan and "mh#" not in plan.split("== Physical Plan ==")[1].split("Exchange")[0]


def test_many_hot_routes_are_cut_to_what_is_broadcast(spark, monkeypatch):
    counts = spark.createDataFrame([(r, r) for r in range(1, 101)], "route bigint, n bigint")
    assert hot_routes(counts, 10).count() == 90
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 50)
    # 10, then 40, then 160: no route is left that is worth a broadcast.
    assert hot_routes(counts, 10) is None
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 60)
    assert rows(hot_routes(counts, 10)) == {(r,): 1 for r in range(41, 101)}


def test_more_shared_routes_than_are_broadcast(documents, monkeypatch):
    expected = as_set(BucketJob(documents).members())
    monkeypatch.setattr(minhash, "BROADCAST_KEYS", 3)
    job = BucketJob(documents)
    assert "LeftSemi" not in plan_text(job.places()) and as_set(job.members()) == expected
