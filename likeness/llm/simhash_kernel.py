"""SimHash fingerprints and pair search on Arrow batches, inside Spark tasks.

Pickled by value: executors need numpy, pyarrow and xxhash only.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
# Shingle hashes whose bits are counted in one pass.
PASS = 1 << 14
# Verified pairs a task holds before it reduces them to a forest.
HELD_PAIRS = 1 << 20


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = raw.split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    wide = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [
            digest(line[a:b], seed)
            for a, b in zip(starts[: len(words) - wide + 1].tolist(), ends[wide - 1 :].tolist())
        ],
        np.uint64,
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PASS):
        part = hashes[at : at + PASS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint_batch(texts: pa.Array, shingle: int, seed: int) -> pa.Array:
    found = [fingerprint(t.as_py(), shingle, seed) for t in texts]
    return pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())


def bit_matrix(prints: np.ndarray) -> np.ndarray:
    """One row of 0s and 1s for each print, lowest bit first."""
    raw = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def count_bits(batches):
    """How many prints have bits i and j both set, as 64 x 64 partial sums."""
    both = np.zeros((BITS, BITS), np.int64)
    n = 0
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), PASS):
            bits = bit_matrix(prints[at : at + PASS]).astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
    cells = np.append(both.ravel(), n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(cells)), pa.int64()), pa.array(cells, pa.int64())], ["cell", "n"]
    )


def probe_rows(batches, parts: list[tuple[list[int], int]]):
    """The keys under which each print is looked up.

    ``parts`` has the bits of each part and the number of them that may differ,
    negative for a part not probed. A print sets up to that many zero bits of
    the part: two prints that differ there in d bits meet at the union of their
    bits, one having set u of them and the other d - u.
    """
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for number, (bits, allowed) in enumerate(parts):
            if allowed < 0:
                continue
            mask = np.uint64(sum(1 << b for b in bits))
            for flips in range(allowed + 1):
                for chosen in combinations(bits, flips):
                    more = np.uint64(sum(1 << b for b in chosen))
                    kept = prints[(prints & more) == 0] if flips else prints
                    n = len(kept)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, number, np.int8)),
                            pa.array(((kept & mask) | more).view(np.int64)),
                            pa.array(np.full(n, flips, np.int8)),
                            pa.array(kept.view(np.int64)),
                        ],
                        ["part", "key", "flips", "print"],
                    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links ``a``-``b`` connect: node and its least node."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def link_groups(part, key, flips, prints, allowed: np.ndarray, distance: int):
    """Forest of the links among rows sorted by ``(part, key)``.

    Compares each row with the d-th row after it, for growing d, as long as
    some group is that long: as many comparisons as pairs in groups, no more
    memory than rows.
    """
    n = len(prints)
    first = np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, d = 0, 0
    while True:
        d += 1
        first = first[first + d < n]
        second = first + d
        same = (key[first] == key[second]) & (part[first] == part[second])
        first, second = first[same], second[same]
        if not len(first):
            break
        near = np.bitwise_count(prints[first] ^ prints[second]) <= distance
        near &= flips[first] + flips[second] <= allowed[part[first]]
        near &= prints[first] != prints[second]
        if near.any():
            held.append((prints[first[near]], prints[second[near]]))
            count += int(near.sum())
        if count > HELD_PAIRS:
            held = [forest(*map(np.concatenate, zip(*held)))]
            count = len(held[0][0])
    if not held:
        return prints[:0], prints[:0]
    return forest(*map(np.concatenate, zip(*held)))


def link_batches(batches, allowed: list[int], distance: int):
    """Links of a partition sorted by ``(part, key)``; holds whole groups only."""
    limits = np.array(allowed)
    rest: list[np.ndarray] | None = None

    def run(columns):
        a, b = link_groups(*columns, limits, distance)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"]
        )

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = [columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].view(np.uint64)]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns)]
        if not len(columns[0]):
            continue
        part, key = columns[:2]
        last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [c[cut:] for c in columns]
        if cut:
            yield run([c[:cut] for c in columns])
    if rest is not None:
        yield run(rest)


def near_stars(batches, distance: int):
    """Rows under which close prints meet, for groups too large to compare.

    Prints within ``distance`` of each other share a code that is within half
    of the distance of the one and the rest of the other. Each print goes to
    all codes so near, at 1 + 64 + 2016 + ... rows.
    """
    near, far = distance // 2, distance - distance // 2
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for flips in range(far + 1):
            for chosen in combinations(range(BITS), flips):
                code = prints ^ np.uint64(sum(1 << b for b in chosen))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(code.view(np.int64)),
                        pa.array(prints.view(np.int64)),
                        pa.array(np.full(len(prints), flips <= near)),
                    ],
                    ["code", "print", "near"],
                )
