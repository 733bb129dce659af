import random

import pytest

from likeness.params import MinHashParams
from likeness.plans.minhash import BucketJob
from likeness.plans.verification import _prefixes, verified_pairs


def corpus():
    """A third of all rows one sentence, some of it with typing errors."""
    rnd = random.Random(6)
    sentence = lambda: "A" + " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(22)) + "."
    hot = sentence()
    texts = [hot] * 30
    for _ in range(20):
        at = rnd.randrange(1, len(hot) - 1)
        texts.append(hot[:at] + "z" + hot[at + 1 :])
    for _ in range(25):
        base = sentence()
        texts += [base, base.replace(base[40:48], "changed!", 1) if rnd.random() < 0.5 else base]
    return [(i, t) for i, t in enumerate(texts)] + [(0, hot), (500, None), (501, "")]


def shingles(text, k):
    return {text[i : i + k] for i in range(len(text) - k + 1)}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.97])
@pytest.mark.parametrize("limits", [{}, {"group_rows": 5, "broadcast_rows": 0}])
def test_against_brute_force(spark, threshold, limits):
    params = MinHashParams()
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    job = BucketJob(docs, params)
    found = verified_pairs(job, threshold, **limits).collect()
    texts = {r.row: (f"{r.doc_id}:{r.ord}", r.sentence) for r in job.vectors.collect()}
    pairs = {(r.hub_row, r.row) for r in job.members().collect() if r.hub_row != r.row}
    expected = []
    for hub, row in pairs:
        a, b = (shingles(texts[x][1], params.shingle_len) for x in (hub, row))
        if len(a & b) / len(a | b) >= threshold:
            expected.append((texts[hub][0], texts[row][0], len(a & b), len(a | b), len(a & b) / len(a | b)))
    assert sorted(map(tuple, found)) == sorted(expected)
    # The fifty copies and near copies give one pair each for a hub, not all pairs.
    assert 30 < len(found) < 4 * len(rows)


def test_prefixes_are_the_rarest(spark):
    sets = spark.createDataFrame(
        [("x", 5, ["a", "b", "c", "d", "e"]), ("y", 5, ["a", "b", "c", "d", "f"]), ("z", 1, ["a"])],
        "key string, n int, shingles array<string>",
    )
    rows = {r.key: r.prefix for r in _prefixes(sets, 0.8).collect()}
    assert {k: len(v) for k, v in rows.items()} == {"x": 2, "y": 2, "z": 1}
    hashes = {r.s: r.h for r in spark.sql("SELECT s, xxhash64(s) AS h FROM VALUES 'a', 'e', 'f' AS t(s)").collect()}
    assert rows["x"][0] == hashes["e"] and rows["y"][0] == hashes["f"] and rows["z"] == [hashes["a"]]


def test_threshold_is_checked(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        verified_pairs(BucketJob(docs), 0)
    assert verified_pairs(BucketJob(docs)).collect() == []
