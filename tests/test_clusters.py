from helpers import rows

from likeness.operators.buckets import bucket_members
from likeness.operators.clusters import (
    clusters_in_parts,
    large_nodes,
    one_hop_clusters,
    pair_edges,
    star_edges,
)

SIGS = "draw int, sig array<bigint>, doc_id bigint, ord int"
EDGES = "src string, dst string"


def test_star_edges_and_one_hop_clusters(spark):
    members = bucket_members(
        spark.createDataFrame([(0, [9], 3, 0), (0, [9], 1, 0), (0, [9], 2, 0), (1, [9], 1, 0), (1, [9], 2, 0)], SIGS)
    )
    edges = star_edges(members)
    assert rows(edges) == {
        ("1:0", "2:0"): 1,
        ("2:0", "1:0"): 1,
        ("1:0", "3:0"): 1,
        ("3:0", "1:0"): 1,
    }
    assert rows(one_hop_clusters(edges)) == {
        ("1:0", 3, 0, 1, "1:0, 2:0, 3:0"): 1,
        ("2:0", 2, 0, 1, "1:0, 2:0"): 1,
        ("3:0", 2, 0, 1, "1:0, 3:0"): 1,
    }


def test_hub_is_the_smallest_number_not_text(spark):
    members = bucket_members(spark.createDataFrame([(0, [1], 10, 0), (0, [1], 9, 0)], SIGS))
    assert rows(members.select("hub_doc").distinct()) == {(9,): 1}


def test_clusters_are_not_transitive(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], EDGES)
    found = {r["node"]: r["members"] for r in one_hop_clusters(edges).collect()}
    assert found == {"a": "a, b", "b": "a, b, c", "c": "b, c"}


def test_large_neighbourhoods_come_in_parts(spark):
    spokes = [("hub", f"m{i}") for i in range(500)]
    edges = spark.createDataFrame(spokes + [(b, a) for a, b in spokes], EDGES)
    large = large_nodes(edges, 100)
    assert rows(large) == {("hub", 500): 1}
    found = clusters_in_parts(edges, large, part_members=60)
    hub = found.filter("node = 'hub'").collect()
    members = [m for r in hub for m in r["members"].split(", ")]
    assert len(hub) == 9 and {r["size"] for r in hub} == {501}
    assert sorted(members) == sorted(["hub"] + [m for _, m in spokes])
    assert found.filter("node <> 'hub' and size = 2 and part = 0").count() == 500


def test_pair_edges(spark):
    pairs = spark.createDataFrame(
        [(0, 3, 7, 2), (1, 4, 2, 7), (0, 0, 5, 5)], "perm int, dist int, id_a bigint, id_b bigint"
    )
    assert rows(pair_edges(pairs)) == {("2", "7"): 1, ("7", "2"): 1}
