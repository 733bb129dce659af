"""Counting quotient filters over packed word numbers, inside Spark tasks.

The numbers of a phrase's words stand side by side in one key of up to 124
bits. An invertible permutation spreads the keys evenly. Its first bits name a
slot, the quotient; all other bits, the remainder, are stored, so nothing is
lost and every key can be had back. A filter is sorted: an ``occupied`` bit for
each slot, a ``run end`` bit for each entry, remainders of just as many bits as
they need, and a counter where an entry counts more than one.

Pickled by value: executors need numpy only.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 4
# Half a key at most, so that both halves fit 64 bits.
HALF_BITS = 62
_HEADER = "<QB"
# Counters of 2 to 256 take a byte; larger ones eight more.
_LARGE = 255


def halves(words: int, bits: int) -> tuple[int, int]:
    """Bits of the left and the right half of a key of so many words."""
    left = (words + 1) // 2
    return left * bits, (words - left) * bits


def packed(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the keys whose words stand in ``columns``."""
    middle = (len(columns) + 1) // 2
    out = []
    for part in (columns[:middle], columns[middle:]):
        half = np.zeros(len(columns[0]), np.uint64)
        for column in part:
            half = half << np.uint64(bits) | column.astype(np.uint64)
        out.append(half)
    return out[0], out[1]


def unpacked(left: np.ndarray, right: np.ndarray, words: int, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    middle = (words + 1) // 2
    out = []
    for half, n in ((left, middle), (right, words - middle)):
        out += [(half >> np.uint64(bits * (n - 1 - i)) & mask).astype(np.int64) for i in range(n)]
    return out


def _mixed(x: np.ndarray, turn: int, bits: int) -> np.ndarray:
    x = (x + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(64 - bits)


def permuted(left: np.ndarray, right: np.ndarray, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network over both halves: keys to keys, one to one."""
    for turn in range(ROUNDS):
        right = right ^ _mixed(left, 2 * turn, sizes[1])
        left = left ^ _mixed(right, 2 * turn + 1, sizes[0])
    return left, right


def restored(left: np.ndarray, right: np.ndarray, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    for turn in reversed(range(ROUNDS)):
        left = left ^ _mixed(right, 2 * turn + 1, sizes[0])
        right = right ^ _mixed(left, 2 * turn, sizes[1])
    return left, right


def counted(left, right, sizes, counts=None):
    """Distinct keys in order, with the sum of their counts (1 each by default)."""
    if sum(sizes) <= 64:
        shift = np.uint64(sizes[1])
        key = left << shift | right
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        left, right = key >> shift, key & np.uint64((1 << sizes[1]) - 1)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        counts = None if counts is None else counts[order]
    first = np.ones(len(left), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(first)
    if counts is None:
        sums = np.diff(np.append(at, len(left)))
    else:
        sums = np.add.reduceat(counts, at) if len(at) else counts
    return left[at], right[at], sums


def _widths(n: int, sizes: tuple[int, int], prefix: int) -> tuple[int, int]:
    """Bits of quotient and of remainder for ``n`` entries that share ``prefix`` bits."""
    quotient = min(max(n, 1).bit_length() - 1, sizes[0] - prefix)
    return quotient, sum(sizes) - prefix - quotient


def encoded(left, right, counts, sizes: tuple[int, int], prefix: int = 0) -> bytes:
    """A filter of distinct sorted keys that agree in their first ``prefix`` bits."""
    n = len(left)
    quotient_bits, bits = _widths(n, sizes, prefix)
    rest = sizes[0] - prefix - quotient_bits
    slot = (left >> np.uint64(rest) & np.uint64((1 << quotient_bits) - 1)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[slot] = True
    run_end = np.ones(n, bool)
    run_end[:-1] = slot[1:] != slot[:-1]
    low = left & np.uint64((1 << rest) - 1)
    shift = np.uint64(sizes[1])
    both = np.empty((n, 2), ">u8")
    both[:, 0] = low >> (np.uint64(64) - shift)
    both[:, 1] = low << shift | right
    wide = -(-bits // 8)
    raw = np.unpackbits(both.view(np.uint8).reshape(n, 16)[:, 16 - wide :], axis=1)
    several = counts > 1
    extra = counts[several] - 2
    return b"".join(
        (
            struct.pack(_HEADER, n, quotient_bits),
            np.packbits(occupied).tobytes(),
            np.packbits(run_end).tobytes(),
            np.packbits(several).tobytes(),
            np.packbits(raw[:, 8 * wide - bits :]).tobytes(),
            np.minimum(extra, _LARGE).astype(np.uint8).tobytes(),
            extra[extra >= _LARGE].astype("<u8").tobytes(),
        )
    )


def decoded(raw: bytes, sizes: tuple[int, int], prefix: int = 0, head: int = 0):
    """Keys and counts of a filter whose keys begin with the ``prefix`` bits of ``head``."""
    n, quotient_bits = struct.unpack_from(_HEADER, raw)
    _, bits = _widths(n, sizes, prefix)
    at = struct.calcsize(_HEADER)

    def take(kind, count, size=1):
        nonlocal at
        found = np.frombuffer(raw, kind, count, at)
        at += count * size
        return found

    def flags(count):
        return np.unpackbits(take(np.uint8, -(-count // 8)), count=count).astype(bool)

    slots = np.flatnonzero(flags(1 << quotient_bits))
    run_end, several = flags(n), flags(n)
    wide = -(-bits // 8)
    remainder = np.zeros((n, 8 * wide), np.uint8)
    remainder[:, 8 * wide - bits :] = np.unpackbits(take(np.uint8, -(-n * bits // 8)), count=n * bits).reshape(n, bits)
    both = np.zeros((n, 16), np.uint8)
    both[:, 16 - wide :] = np.packbits(remainder, axis=1)
    high, low = both.view(">u8").astype(np.uint64).T if n else np.zeros((2, 0), np.uint64)
    run = np.cumsum(run_end) - run_end
    slot = slots[run].astype(np.uint64)
    shift = np.uint64(sizes[1])
    rest = sizes[0] - prefix - quotient_bits
    left = low >> shift | high << (np.uint64(64) - shift)
    left = left & np.uint64((1 << rest) - 1) | slot << np.uint64(rest)
    left = left | np.uint64(head << (sizes[0] - prefix))
    counts = np.ones(n, np.int64)
    extra = take(np.uint8, int(several.sum())).astype(np.int64)
    large = extra == _LARGE
    extra[large] = take("<u8", int(large.sum()), 8)
    counts[several] = extra + 2
    return left, low & np.uint64((1 << sizes[1]) - 1), counts


def split(left, right, counts, sizes: tuple[int, int], prefix: int, more: int):
    """``(head, filter)`` of each group of keys that agrees in ``prefix + more`` bits."""
    heads = left >> np.uint64(sizes[0] - prefix - more)
    begins = np.flatnonzero(np.diff(heads, prepend=heads[:1] + np.uint64(1))) if len(heads) else []
    for a, b in zip(begins, [*begins[1:], len(heads)]):
        yield int(heads[a]), encoded(left[a:b], right[a:b], counts[a:b], sizes, prefix + more)


def merged(filters: list[bytes], sizes: tuple[int, int], prefix: int, head: int):
    """Keys and summed counts of sorted filters of one prefix."""
    parts = [decoded(raw, sizes, prefix, head) for raw in filters]
    left, right, counts = (np.concatenate(x) for x in zip(*parts))
    return counted(left, right, sizes, counts)
