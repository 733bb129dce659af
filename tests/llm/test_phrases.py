import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from likeness.llm import phrases
from likeness.llm import phrases_kernel as kernel
from likeness.llm import quotient_filter as qf

SCHEMA = "lang string, text string, rank int, word string, ids array<int>"


def plain(rows, min_count, top, longest=4):
    """The definition, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in often.items():
            longer = max((b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if longer and 100 * longer >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, 7, "x", [1]) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.mine(table, **options).collect()))


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = ["The", "cat", "sat", "on", "mat", "É", "dog", "ran", "far", "日本", "x#y", "a", "b"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; "]
    rows = []
    for i in range(240):
        parts = [vocabulary[j] + ends[e] for j, e in zip(rng.zipf(1.6, 60) % len(vocabulary), rng.integers(0, len(ends), 60))]
        rows.append((["en", "en", None, "de"][i % 4], "".join(parts)))
    rows += [("en", "New York City hall is old")] * 40 + [("de", None), (None, ""), ("en", " . ,, "), ("xx", "few words here")]
    rows += [("en", "long text of THIS kind, again " * 300), ("de", "kein ende " * 400)]
    return rows


@pytest.mark.parametrize(
    "options",
    [{}, {"chunk_bytes": 300}, {"chunk_bytes": 2_000, "merge_bytes": 512, "split_bits": 2}, {"top": 5}, {"longest": 2}],
)
def test_phrases(spark, options):
    rows = corpus()
    expected = plain(rows, 30, options.get("top", 2_000), options.get("longest", 4))
    assert len(expected) > 10 and any(r[0] == "und" for r in expected)
    assert mined(spark, rows, **options) == expected


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("en", None), (None, ""), ("en", "one two")]) == []


def test_scores_past_63_bits(spark):
    """Counts as large as a web corpus has them, put in behind the filters."""
    known = spark.createDataFrame([("en", bytearray(b"new"), 9_000_000_000_000, 1), ("en", bytearray(b"york"), 6_000_000_000_000, 2)], "lang string, word binary, n long, id long")
    grams = spark.createDataFrame([([1, 2], 5_000_000_000_000)], "ids array<long>, a long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    (row,) = phrases._best(grams, known, totals, 10).collect()
    assert tuple(row) == ("en", 1, "new york", 5 * 10**12, 9 * 10**12, 6 * 10**12, 10**15, 666_666)


@pytest.mark.parametrize("words, bits", [(2, 1), (2, 17), (3, 13), (4, 16), (4, 17), (4, 31)])
def test_filter_round_trip(words, bits):
    rng = np.random.default_rng(bits)
    ids = [rng.zipf(1.5, 5_000) % min(1 << bits, 1 << 30) for _ in range(words)]
    sizes = qf.halves(words, bits)
    left, right = qf.permuted(*qf.packed(ids, bits), sizes)
    assert int(left.max()) < 1 << sizes[0] and int(right.max()) < 1 << sizes[1]
    back = qf.unpacked(*qf.restored(left, right, sizes), words, bits)
    assert all((a == b).all() for a, b in zip(ids, back))
    expected = Counter(zip(left.tolist(), right.tolist()))
    found = qf.counted(left, right, sizes)
    prefix = min(3, bits)
    total = Counter()
    for head, raw in qf.split(*found, sizes, 0, prefix):
        a, b, n = qf.merged([raw, raw], sizes, prefix, head)
        assert (a >> np.uint64(sizes[0] - prefix) == head).all()
        total.update(dict(zip(zip(a.tolist(), b.tolist()), n.tolist())))
    assert total == {k: 2 * n for k, n in expected.items()}


def test_large_counters():
    sizes = qf.halves(2, 8)
    keys = np.arange(300, dtype=np.uint64)
    counts = np.arange(1, 301) ** 6
    left, right = keys >> np.uint64(8), keys & np.uint64(255)
    a, b, n = qf.decoded(qf.encoded(left, right, counts, sizes), sizes)
    assert (a == left).all() and (b == right).all() and (n == counts).all()


def test_segments_keep_words():
    raw = ("word " * 50 + "x" * 400 + "\n" + "end. " * 30).encode()
    parts = list(kernel.segments(raw, 64))
    assert b"".join(parts) == raw
    assert [t for p in parts for t in kernel.tokens(p)] == kernel.tokens(raw)


def test_numbers_of_a_chunk():
    for codes in ([], [0], [65_534, 65_535, 70_000, 1, 65_535, 2**31]):
        assert kernel.unpacked_codes(kernel.packed_codes(np.array(codes, np.int64))).tolist() == codes
