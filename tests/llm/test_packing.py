import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from likeness.llm import packing
from likeness.llm import packing_kernel as kernel

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, length string, sequence_id int"
TEXTS = [
    "Hello, world! it's   fine\tnow\n\nO'Neill's 3,14 don't",
    "É́tude Σας ΟΔΟΣ İstanbul ﬁ ǅ é ́x 日本語 　wide space\x85next\x1cx",
    "x<|endoftext|>y <|startoftext|> <|endoftext", "🙂🙂 👩‍👩‍👧 ½ ² ٣٤", "", None, " \n\t ", "a" * 3_000, "word " * 5_000, "tie", "tie",
]


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(TEXTS)]
    rows += [(7, "repeated id", "x", "y", 1), (None, "no id", "x", "y", 1), (3, TEXTS[3], "x", "y", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def expected_ids(rows):
    tokenizer = library()
    return [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in rows]


def check(packed, expected, size):
    """Every id of every document in one piece, sequences without gaps and not too long."""
    pieces = Counter()
    for doc_id, ids in expected:
        for start in range(0, len(ids), size):
            part = np.array(ids[start : start + size], "<u4").tobytes()
            pieces[doc_id, start, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == pieces
    inside = defaultdict(list)
    for r in packed:
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= size
    assert sorted(inside) == list(range(len(inside)))
    return len(inside)


def test_ids_and_places(spark, docs):
    packed = packing.digests(docs, PATH).collect()
    assert check(packed, expected_ids(docs.collect()), packing.SIZE) <= 4


def test_pieces_join_to_the_whole(spark, docs):
    packed = packing.pack(docs, PATH, size=50)
    rows = packing.sequences(packed).collect()
    expected = expected_ids(docs.collect())
    assert sum(len(r.ids) for r in rows) == 4 * sum(len(ids) for _, ids in expected)
    assert all(sum(r.lengths) * 4 == len(r.ids) <= 200 for r in rows)
    held = Counter(x for r in rows for x in np.frombuffer(r.ids, "<u4").tolist())
    assert held == Counter(x for _, ids in expected for x in ids)


def test_slices_of_the_plan(spark):
    rng = np.random.default_rng(5)
    lengths = [(i, int(n)) for i, n in enumerate(rng.integers(1, 65, 900))] + [(1_000 + i, 7) for i in range(500)]
    rows = spark.createDataFrame(lengths, "id long, length long").repartition(5)
    found = packing.place(rows, 64, plan_rows=20).collect()
    inside = defaultdict(list)
    for r in found:
        inside[r.sequence_id].append((r.offset, r.length))
    assert sorted((r.id, r.length) for r in found) == sorted(lengths)
    for parts in inside.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64


def test_empty(spark, docs):
    assert packing.digests(docs.limit(0), PATH).collect() == []
    assert packing.sequences(packing.pack(docs.limit(0), PATH)).collect() == []


def rooms(lengths, size):
    """One piece after the other, longest first, into the sequence with the most room."""
    free = []
    for n in sorted(lengths, reverse=True):
        best = max(range(len(free)), key=free.__getitem__, default=None)
        if best is None or free[best] < n:
            free.append(size - n)
        else:
            free[best] -= n
    return Counter(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_shortest_pack_first(seed):
    rng = np.random.default_rng(seed)
    size = 40
    lengths = (rng.integers(1, size + 1, 400) if seed % 2 else np.minimum(rng.zipf(1.4, 400), size)).tolist()
    if seed == 5:
        lengths = [3] * 301
    table = kernel.plan(Counter(lengths), size)
    used, got, ends = Counter(), Counter(), defaultdict(set)
    for length, rank, count, first, offset in table.tolist():
        assert rank == got[length]
        got[length] += count
        for s in range(first, first + count):
            used[s] += length
            ends[s] |= {(offset, 0), (offset + length, 1)}
    for s, found in ends.items():  # each piece begins where another ends
        assert {a for a, e in found if e} - {a for a, e in found if not e} == {used[s]}
    assert got == Counter(lengths)
    assert Counter(size - n for n in used.values()) == rooms(lengths, size)
    with pytest.raises(ValueError):
        kernel.plan({size + 1: 1}, size)


def test_segments(monkeypatch):
    monkeypatch.setattr(kernel, "SEGMENT", 16)
    raw = b"some words and " + b"x" * 100 + b" more\nlines\n here " + b"y" * 40
    parts = list(kernel.segments(raw))
    assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()


def test_stretches_have_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(kernel, "SEGMENT", 300)
    monkeypatch.setattr(kernel, "HELD_RUNS", 20)
    monkeypatch.setattr(kernel, "HELD_BYTES", 8)
    rng = np.random.default_rng(17)
    parts = ["Word", "word.", "(word)", "\"Word\"]", "[1984].", "x=", "=\u0338", "WORD,,", "it's", "IT'S!", "'s", "n't", "x", ".", "...", "a.b.", "3.", "½.", "É.", "e", "́", "日本.", "<|endoftext|>",
             "<|ENDOFTEXT|>.", "ΣΑΣ.", "İ.", "ß!", "\x85", "　", " ", " ", " ", "\n", "\t", "🙂", "#$%", "ǅ,", "‍", "ﬁ."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.integers(0, 60))) for _ in range(400)] + ["", " "]
    runs = kernel.Runs(library().to_str())
    tokenizer = library()
    for text in texts:
        ids = runs.ids(text.encode())
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
