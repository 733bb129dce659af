import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from likeness.llm import byte_repeats, passages
from likeness.llm.automaton_kernel import Automaton
from likeness.llm.run_index_kernel import RunIndex


def plain_bytes(docs, size):
    raws = [(t or "").encode() for _, t in docs]
    count = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for (doc_id, _), r in zip(docs, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if count[r[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((doc_id, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def plain_words(docs, size):
    seen, out = set(), []
    for doc_id, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(["a", "b", "aa", "é"]) for _ in range(n))
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(100)]
    docs += [(200 + i, docs[rnd.randrange(100)][1][rnd.randrange(10) :]) for i in range(40)]
    return docs + [(300, None), (301, ""), (302, "a " * 500), (303, "a " * 300), (304, "ab" * 400)]


@pytest.mark.parametrize("group_cells", [8_000, 3])
def test_against_brute_force(spark, group_cells):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = byte_repeats.digests(
        byte_repeats.remove_repeats(df, window=12, gram=4, group_cells=group_cells, task_bytes=2_000)
    )
    assert sorted(map(tuple, got.collect()), key=str) == plain_bytes(docs, 12)
    got = passages.digests(
        passages.remove_repeats(df, window=5, gram=2, group_cells=group_cells, shard_words=500)
    )
    assert sorted(map(tuple, got.collect()), key=str) == plain_words(docs, 5)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(90))
    docs = [(None, text), (1, text), (1, text), (2, "x " + text), (3, "short")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, row int, marks int")
    got = passages.digests(passages.remove_repeats(df)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 90), ("1", 90), ("2", 90), ("3", 0), ("None", 0)]
    got = byte_repeats.digests(byte_repeats.remove_repeats(df, window=100, gram=20)).collect()
    assert sorted((str(r.doc_id), r.n_spans) for r in got) == [("1", 1), ("1", 1), ("2", 1), ("3", 0), ("None", 1)]


def test_empty_table_and_long_text(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], schema)
    assert passages.remove_repeats(none).count() == byte_repeats.remove_repeats(none).count() == 0
    rnd = random.Random(10)
    long = " ".join(f"{rnd.randrange(10**9)}" for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long[1_000_000:1_500_000])], schema)
    got = {r.doc_id: r.n_removed for r in byte_repeats.digests(byte_repeats.remove_repeats(df)).collect()}
    assert got == {1: 500_000, 2: 500_000}
    got = {r.doc_id: r.n_removed for r in passages.digests(passages.remove_repeats(df)).collect()}
    assert got[1] == 0 and got[2] > 49_000


def test_statistics_of_both_indexes():
    rnd = random.Random(11)
    for _ in range(60):
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 40))) for _ in range(4)]
        symbols = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, 0) for p in parts])
        line = [int(s) if s else ("end", i) for i, s in enumerate(symbols)]
        n = len(line)

        def match(i, j):
            k = 0
            while i + k < n and j + k < n and line[i + k] == line[j + k]:
                k += 1
            return k

        best = [max(match(i, j) for j in range(n) if j != i) for i in range(n)]
        assert RunIndex(symbols).stream(n).tolist() == best
        automaton = Automaton()
        for e, symbol in enumerate(line):
            known = automaton.read(symbol)
            ends = [k for k in range(1, e + 2) if any(line[j - k + 1 : j + 1] == line[e - k + 1 : e + 1] for j in range(k - 1, e))]
            assert known == max(ends, default=0)
