"""Cutting texts into numbered words and counting their phrases, inside Spark tasks.

Pickled by value, with ``quotient_filter``: executors need numpy and pyarrow only.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle

from likeness.llm import quotient_filter as qf

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text that a chunk gathers, of one language.
CHUNK_BYTES = 4 << 20
# What ends a piece, and what parts words besides.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(
    bytes(range(0x41, 0x5B)) + ENDS + b"\t", bytes(range(0x61, 0x7B)) + b"." * len(ENDS) + b" "
)
MARK = b"."  # stands between pieces; no word holds it
# The task's number takes the upper bits of a chunk's number.
_CHUNK_BITS = 33

CHUNKS = pa.schema(
    [
        ("shard", pa.int64()),
        ("lang", pa.string()),
        ("word", pa.binary()),
        ("number", pa.int32()),
        ("n", pa.int64()),
        ("lead", pa.int32()),
        ("codes", pa.binary()),
    ]
)


def tokens(raw: bytes) -> list[bytes]:
    """Words, lower-cased, with a mark wherever a piece ends."""
    return raw.translate(FOLD).replace(MARK, b" . ").split()


def segments(raw: bytes, size: int):
    """A long text cut behind white space, about ``size`` bytes at a time."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and raw[end : end + 1] not in (b" ", b"\t", b"\n"):
            step = min(x for x in (raw.find(b" ", end), raw.find(b"\t", end), raw.find(b"\n", end), len(raw)) if x >= 0)
            end = step
        yield raw[at:end]
        at = end


def chunk_batches(batches, longest: int, size: int = CHUNK_BYTES):
    """``(lang, text)`` to chunks: words with numbers of the chunk's own, and the text as such numbers.

    ``lead`` words at the begin of a chunk belong to the one before and count
    there: they give phrases that cross the border of a text's segments.
    """
    number = TaskContext.get().partitionId() << _CHUNK_BITS
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def chunk(lang, words, lead=0):
        nonlocal number
        coded = pa.array(words, pa.binary()).dictionary_encode()
        codes = coded.indices.to_numpy()
        distinct = coded.dictionary
        n = np.bincount(codes[lead:], minlength=len(distinct))
        real = np.flatnonzero([w != MARK for w in distinct.to_pylist()])
        rows = len(real)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(rows, number)),
                pa.array([lang] * rows, pa.string()),
                distinct.take(pa.array(real)),
                pa.array(real.astype(np.int32)),
                pa.array(n[real].astype(np.int64)),
                pa.nulls(rows, pa.int32()),
                pa.nulls(rows, pa.binary()),
            ],
            schema=CHUNKS,
        )
        yield pa.RecordBatch.from_pylist(
            [{"shard": number, "lang": lang, "lead": lead, "codes": packed_codes(codes)}], CHUNKS
        )
        number += 1

    def flush(lang):
        words = tokens(b"\n".join(held.pop(lang)))
        sizes.pop(lang)
        if words:
            yield from chunk(lang, words)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if len(raw) > size:
                before: list[bytes] = []
                for part in segments(raw, size):
                    words = tokens(part)
                    if words:
                        yield from chunk(lang, before + words, len(before))
                        before = (before + words)[1 - longest :] if longest > 1 else []
            elif raw:
                held.setdefault(lang, []).append(raw)
                sizes[lang] = sizes.get(lang, 0) + len(raw)
                if sizes[lang] >= size:
                    yield from flush(lang)
                elif sum(sizes.values()) >= 4 * size:
                    yield from flush(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from flush(lang)


# Numbers of a chunk in two bytes; this one stands for a larger, kept behind them.
_MANY = 0xFFFF


def packed_codes(codes: np.ndarray) -> bytes:
    """Numbers from 0; the first words of a chunk, and so most of its text, have small ones."""
    large = codes[codes >= _MANY].astype("<u4")
    return np.minimum(codes, _MANY).astype("<u2").tobytes() + large.tobytes() + np.array([len(codes)], "<u8").tobytes()


def unpacked_codes(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u8", 1, len(raw) - 8)[0])
    codes = np.frombuffer(raw, "<u2", n).astype(np.int64)
    codes[codes == _MANY] = np.frombuffer(raw, "<u4", (len(raw) - 8 - 2 * n) // 4, 2 * n)
    return codes


FILTERS = pa.schema(
    [("words", pa.int32()), ("head", pa.int64()), ("shard", pa.int64()), ("filter", pa.binary())]
)


def _filters(rows) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(FILTERS)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FILTERS)], schema=FILTERS)


def count_shard(chunk: pa.Table, numbers: pa.Table, longest: int, bits: int, prefix: int) -> pa.Table:
    """Filters of the phrases of a chunk, one for each length and prefix.

    ``numbers`` gives the corpus numbers of the words that are frequent; others
    are 0 and part phrases as the end of a piece does.
    """
    out = []
    known = np.zeros(int(max([0, *numbers.column("number").to_pylist()])) + 1, np.int64)
    known[numbers.column("number").to_numpy()] = numbers.column("id").to_numpy()
    for shard, lead, raw in zip(*(chunk.column(c).to_pylist() for c in ("chunk", "lead", "codes"))):
        codes = unpacked_codes(raw)
        ids = np.where(codes < len(known), known[np.minimum(codes, len(known) - 1)], 0)
        whole = ids > 0
        for words in range(2, longest + 1):
            n = len(ids) - words + 1
            if n <= 0:
                break
            whole = whole[:n] & (ids[words - 1 :] > 0)
            at = np.flatnonzero(whole)
            at = at[at + words > lead]
            if not len(at):
                continue
            sizes = qf.halves(words, bits)
            left, right = qf.packed([ids[at + i] for i in range(words)], bits)
            left, right = qf.permuted(left, right, sizes)
            found = qf.counted(left, right, sizes)
            out += [(words, head, shard, raw) for head, raw in qf.split(*found, sizes, 0, prefix)]
    return _filters(out)


def merge_filters(filters: pa.Table, bits: int, prefix: int, more: int) -> pa.Table:
    """One filter for those of a prefix, parted by ``more`` bits."""
    words, head, bundle = (filters.column(c)[0].as_py() for c in ("words", "head", "bundle"))
    sizes = qf.halves(words, bits)
    found = qf.merged(filters.column("filter").to_pylist(), sizes, prefix, head)
    return _filters([(words, h, bundle, raw) for h, raw in qf.split(*found, sizes, prefix, more)])


PHRASES = pa.schema([("ids", pa.list_(pa.int64())), ("a", pa.int64())])


def frequent_phrases(filters: pa.Table, bits: int, prefix: int, min_count: int) -> pa.Table:
    """Phrases of all filters of a prefix that occur ``min_count`` times: word numbers, count."""
    words, head = (filters.column(c)[0].as_py() for c in ("words", "head"))
    sizes = qf.halves(words, bits)
    left, right, counts = qf.merged(filters.column("filter").to_pylist(), sizes, prefix, head)
    often = counts >= min_count
    left, right = qf.restored(left[often], right[often], sizes)
    ids = np.stack(qf.unpacked(left, right, words, bits), axis=1)
    return pa.Table.from_arrays(
        [pa.array(ids.tolist(), PHRASES.field("ids").type), pa.array(counts[often], pa.int64())], schema=PHRASES
    )
