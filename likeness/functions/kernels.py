"""Numpy work on Arrow batches, run inside Spark tasks.

The module is pickled by value into the UDFs that use it, so executors need
numpy and pyarrow but no copy of this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHARS_PER_WORD = 3  # 21-bit code points in one 64-bit word
CHAR_BITS = 21
# Characters hashed per numpy pass: keeps the working set inside the L2 cache.
BLOCK_CHARS = 1 << 15
# Signature bits per word. Seven bytes leave the sign bit clear, so comparing
# words as signed longs compares the bits.
WORD_BITS = 56


def bind(kernel, *args):
    """A one-column batch function with the other arguments fixed."""

    def batch(column: pa.Array) -> pa.Array:
        return kernel(column, *args)

    return batch


# -- shingle hashing ---------------------------------------------------------


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a batch end to end, and the length of each row."""
    filled = pc.fill_null(texts, "")
    lengths = pc.utf8_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(filled.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, lengths


def shingle_hashes(points: np.ndarray, k: int, a: np.ndarray, b: np.ndarray, bits: int):
    """Yield each function's hash of every window of ``k`` code points."""
    n = len(points) - k + 1
    words = []
    for first in range(0, k, CHARS_PER_WORD):
        word = points[first : first + n].copy()
        for j in range(1, min(CHARS_PER_WORD, k - first)):
            word |= points[first + j : first + j + n] << np.uint64(CHAR_BITS * j)
        words.append(word)
    term = np.empty(n, np.uint64)
    for multipliers, addend in zip(a, b):
        total = np.full(n, addend)
        for word, multiplier in zip(words, multipliers):
            np.multiply(word, multiplier, out=term)
            total += term
        total >>= np.uint64(64 - bits)
        yield total


def row_blocks(lengths: np.ndarray, k: int):
    """Runs of rows of about ``BLOCK_CHARS`` characters that have shingles."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        start = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, start + BLOCK_CHARS, "right")))
        rows = np.arange(first, last)
        rows = rows[lengths[rows] >= k]
        if len(rows):
            yield rows, int(start), int(ends[last - 1]), ends[rows] - lengths[rows] - start
        first = last


def segment_bounds(starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """``reduceat`` offsets: every even result is one row, odd ones are gaps."""
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2] = starts
    bounds[1::2] = starts + counts
    return bounds[:-1] if bounds[-1] >= n else bounds


def as_lists(values: np.ndarray, item: pa.DataType, present: np.ndarray | None = None) -> pa.Array:
    """A list column from the rows of a matrix."""
    rows, width = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(width))
    mask = None if present is None else pa.array(~present)
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), item), mask=mask)


def minhash_batch(texts: pa.Array, k: int, a: np.ndarray, b: np.ndarray, bits: int) -> pa.Array:
    points, lengths = code_points(texts)
    out = np.zeros((len(lengths), len(b)), np.int64)
    for rows, start, end, starts in row_blocks(lengths, k):
        bounds = segment_bounds(starts, lengths[rows] - k + 1, end - start - k + 1)
        for s, hashed in enumerate(shingle_hashes(points[start:end], k, a, b, bits)):
            out[rows, s] = np.minimum.reduceat(hashed, bounds)[0::2]
    return as_lists(out, pa.int64(), lengths >= k)


def argmin_batch(texts: pa.Array, k: int, a: np.ndarray, b: np.ndarray, bits: int) -> pa.Array:
    """1-based position of the first window that attains each minimum."""
    points, lengths = code_points(texts)
    out = np.zeros((len(lengths), len(b)), np.int32)
    for rows, start, end, starts in row_blocks(lengths, k):
        counts = lengths[rows] - k + 1
        n = end - start - k + 1
        bounds = segment_bounds(starts, counts, n)
        # Each row's minimum over its windows, and no hash at all in the gaps.
        edges = np.diff(np.stack([starts, starts + counts], 1).ravel(), prepend=0, append=n)
        wanted = np.full(2 * len(rows) + 1, np.iinfo(np.uint64).max)
        for s, hashed in enumerate(shingle_hashes(points[start:end], k, a, b, bits)):
            wanted[1::2] = np.minimum.reduceat(hashed, bounds)[0::2]
            hits = np.flatnonzero(hashed == np.repeat(wanted, edges))
            out[rows, s] = hits[np.searchsorted(hits, starts)] - starts + 1
    return as_lists(out, pa.int32(), lengths >= k)


# -- random projection -------------------------------------------------------


def sign_words_batch(vectors: pa.Array, planes: np.ndarray, rounds: int) -> pa.Array:
    """Per row and round, the sign bits of all dot products packed to words.

    ``planes`` is ``(vec_len, rounds * sig_len)``. Bits fill each word from the
    top; the last word is padded with zeros.
    """
    vec_len = planes.shape[0]
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if vectors.null_count or (lengths != vec_len).any():
        raise ValueError(f"every vector must have {vec_len} values")
    values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    bits = values.reshape(-1, vec_len).astype(np.float64) @ planes >= 0
    bits = bits.reshape(len(vectors) * rounds, -1)
    words = -(-bits.shape[1] // WORD_BITS)
    padded = np.zeros((len(bits), words * WORD_BITS), np.bool_)
    padded[:, : bits.shape[1]] = bits
    packed = np.packbits(padded.reshape(-1, WORD_BITS), axis=1)
    eight = np.zeros((len(packed), 8), np.uint8)
    eight[:, 1:] = packed
    longs = eight.view(">i8").astype(np.int64).reshape(len(bits), words)
    offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * np.int32(rounds))
    return pa.ListArray.from_arrays(offsets, as_lists(longs, pa.int64()))
