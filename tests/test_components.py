import random

import pytest

from likeness.plans.components import connected_components


def found(spark, edges, **limits):
    table = spark.createDataFrame(edges, "src string, dst string, extra int").repartition(3)
    rows = [tuple(r) for r in connected_components(table, **limits).collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


LIMITS = [{}, {"broadcast_nodes": 0}, {"broadcast_nodes": 0, "group_rows": 5}]


@pytest.mark.parametrize("limits", LIMITS)
def test_random_graphs(spark, limits):
    rnd = random.Random(4)
    edges = [(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}", 1) for _ in range(110)]
    edges += [("hub", f"m{i}", 1) for i in range(40)] + [(f"m{i}", "hub", 1) for i in range(40)]
    edges += [("lone", "lone", 1), (None, "n1", 1), ("n2", None, 1), ("é", "日", 1)]
    assert found(spark, edges, **limits) == plain(edges)


def test_long_path(spark):
    names = [f"p{i:04}" for i in range(1000)]
    random.Random(5).shuffle(names)
    edges = [(a, b, 0) for a, b in zip(names, names[1:])]
    assert found(spark, edges) == dict.fromkeys(names, "p0000")


def test_no_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, "a", 0)]) == {}
