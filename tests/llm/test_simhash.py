import random
from itertools import product

import numpy as np
import pytest
import xxhash

from likeness.llm import simhash
from likeness.llm.graph import components
from likeness.llm.simhash_kernel import fingerprint


def plain_print(text):
    words = text.lower().split()
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rnd = random.Random(3)
    for n in [0, 1, 2, 3, 4, 50]:
        text = " ".join(rnd.choice(["Aa", "b", "cc", "é"]) for _ in range(n))
        assert fingerprint(text, 3, 42) == plain_print(text)


def roots_of(points, distance):
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in product(range(len(points)), repeat=2):
        if (points[i] ^ points[j]).bit_count() <= distance:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [points[find(i)] for i in range(len(points))]


def clustered(rnd, n):
    centres = [rnd.getrandbits(64) for _ in range(12)]
    return sorted({rnd.choice(centres) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) for _ in range(n)})


def test_search_is_exact_by_any_plan(spark):
    rnd = random.Random(4)
    points = clustered(rnd, 400)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    prints = spark.createDataFrame([(p,) for p in signed], "print long").repartition(3)
    n, both = simhash.bit_counts(prints)
    assert n == len(points)
    expected = roots_of(points, 3)
    plans = [simhash.plan(n, both)]
    plans += [[(list(range(0, 32)), 1), (list(range(32, 64)), 1)], [(list(range(0, 40)), 2), (list(range(40, 64)), 0)]]
    for plan in plans:
        for limit in (32_768, 3):
            found = components(simhash.close_prints(prints, plan, 3, limit))
            by_node = {r.node: r.root for r in found.collect()}
            groups = {}
            for p, s, e in zip(points, signed, expected):
                groups.setdefault(e, set()).add(by_node.get(s, s))
            assert all(len(g) == 1 for g in groups.values())
            assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_thresholds_keep_the_promise():
    rnd = np.random.default_rng(5)
    for n in (10, 10**6, 10**10):
        bits = (rnd.random((200, 64)) < 0.4).astype(np.int64)
        plan = simhash.plan(n, bits[:n].T @ bits[:n] * (n // 200 or 1))
        assert sorted(b for part, _ in plan for b in part) == list(range(64))
        assert sum(t for _, t in plan) == 3 - len(plan) + 1


def test_counts_have_to_fit():
    with pytest.raises(ValueError):
        simhash.plan(10, np.full((64, 64), 11))


def test_one_row_stays_whatever_the_order(spark):
    base = [f"w{i}" for i in range(300)]
    near = " ".join([*base[:150], "other", *base[151:]])
    rows = [(1, " ".join(base), "b"), (1, near, "a"), (1, " ".join(base), "a"), (None, "alone here", "x"), (None, "alone here", "y"), (2, near, "c")]
    assert simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("root").distinct().count() == 2
    found = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        for tasks in (1, 4):
            df = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(tasks)
            found.add(tuple(sorted(map(str, simhash.one_of_each(df).collect()))))
    assert len(found) == 1 and len(found.pop()) == 2


def test_very_long_text(spark):
    text = " ".join(f"v{i % 977}" for i in range(400_000))
    df = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    prints = {r.doc_id: r.print for r in simhash.near_duplicates(df).collect()}
    assert prints[1] % (1 << 64) == plain_print(text) and prints[2] % (1 << 64) == plain_print(text + " end")


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, 1), (3, text, 1), (3, text, 1), (None, text, 1), (7, None, 1), (6, "", 1), (9, "other words here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("5", 3), ("3", 3), ("3", 3), ("None", 3), ("7", 6), ("6", 6), ("9", 9)])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    unique = df.filter("doc_id IN (5, 6, 9)")
    assert sorted(r.doc_id for r in simhash.one_of_each(unique).collect()) == [5, 6, 9]


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
