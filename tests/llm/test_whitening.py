import numpy as np
import pytest

from likeness.llm import whitening
from likeness.llm import whitening_kernel as kernel

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k=8):
    """From the covariance itself."""
    x = np.array([np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) + 100_000 for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-18 * values[0]).sum()))
    off = n * x.astype(object) - sums
    deviations = (off * off).sum(axis=1)
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    return n, deviations, white, values[:k] / values.sum(), vectors[:, :k]


def check(found, rows, compare=True):
    n, deviations, white, explained, _ = plain(rows)
    k = len(explained)
    rows_of = {}
    for r in found:
        rows_of.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    assert len(found) == len(rows) * k
    for at, (i, _) in enumerate(rows):
        own = rows_of[i]
        assert sorted(own) == list(range(1, k + 1))
        assert {int(r.deviation) for r in own.values()} == {deviations[at]}
    got = np.array([[rows_of[i][c].whitened for c in range(1, k + 1)] for i, _ in rows])
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-8
    if compare:
        signs = np.sign((got * white).sum(axis=0))
        assert np.abs(got * signs - white).max() < 1e-6


def test_against_the_covariance(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(300, 12)) * (0.8 ** np.arange(12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(mixed.astype(np.float32))]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0])]
    found = whitening.whiten(frame(spark, rows + bad)).collect()
    check(found, rows)
    ones = {r.component for r in found}
    assert ones == set(range(1, 9))


def test_little_rank_and_repeated_values(spark):
    """Chains that end early: a plane in six dimensions, and a cross with equal variances."""
    rng = np.random.default_rng(2)
    flat = rng.integers(-900, 900, (50, 2)) @ np.array([[1, 2, 0, -1, 1, 0], [0, 1, 1, 1, -3, 0]]) / 1024
    rows = [(i, v) for i, v in enumerate(flat.tolist())]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)
    cross = [(np.eye(4) * s)[i].tolist() for s in (1.0, -1.0) for i in range(4)]
    rows = list(enumerate(cross))
    check(whitening.whiten(frame(spark, rows)).collect(), rows, compare=False)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [0.5, 0.0]), (1, [0.5, 0.0]), (None, [0.0, 1.0]), (2, [-1.0, 0.25])]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert len(found) == 8 and sum(r.vec_id is None for r in found) == 2 and {r.n for r in found} == {4}
    assert whitening.digests(whitening.whiten(frame(spark, rows))).schema["deviation"].dataType.simpleString() == "bigint"


def test_deviations_past_63_bits():
    x = np.array([[1, 5], [100_000, 7]], np.int64)
    n, sums = 10**12, [5 * 10**13, 10**12]
    expected = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert [int(d) for d in kernel.deviations(x, n, sums).to_pylist()] == expected


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_SUMS", 2)
    rows = [(i, [i / 7, (i * i % 5) / 3, 1.0]) for i in range(40)]
    table = frame(spark, rows).repartition(7)
    found = whitening.whiten(table, components=2).collect()
    _, deviations, white, explained, _ = plain(rows, 2)
    assert len(found) == 80 and {int(r.deviation) for r in found} == set(deviations)
