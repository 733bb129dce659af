"""A run-compressed Burrows-Wheeler index of a few megabytes, inside Spark tasks.

Pickled by value, with ``cells_kernel``: executors need numpy and pyarrow only.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from likeness.llm import cells_kernel

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACKED = 7  # symbols of 9 bits in a key
SYMBOL_BITS = 9


def packed(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols from each place on; zeros after the first separator (0)."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    live = np.ones(n, bool)
    for i in range(PACKED):
        ahead = np.zeros(n, np.int64)
        ahead[: n - i] = symbols[i:]
        key = key << SYMBOL_BITS | np.where(live, ahead, 0)
        live &= ahead > 0
    return key


def suffix_order(symbols: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, each up to its own separator.

    Separators count as different from each other, in order of place. Sorts by
    seven symbols, then doubles: places that still tie are sorted by the rank
    of the place as far ahead as is already compared.
    """
    n = len(symbols)
    order = np.argsort(key, kind="stable")
    ends = (key & ((1 << SYMBOL_BITS) - 1)) == 0  # reaches a separator
    sorted_key = key[order]
    opens = np.ones(n, bool)
    opens[1:] = (sorted_key[1:] != sorted_key[:-1]) | ends[order[1:]]
    group = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    sizes = np.bincount(group, minlength=n)
    open_places = order[sizes[group] > 1]
    ahead = PACKED
    while len(open_places):
        pair = rank[open_places] * n + rank[open_places + ahead]
        by = np.argsort(pair, kind="stable")
        open_places, pair = open_places[by], pair[by]
        base = pair // n
        index = np.arange(len(by))
        new_base = np.ones(len(by), bool)
        new_base[1:] = base[1:] != base[:-1]
        begin = np.maximum.accumulate(np.where(new_base, index, 0))
        order[base + index - begin] = open_places
        split = np.ones(len(by), bool)
        split[1:] = pair[1:] != pair[:-1]
        inner = np.maximum.accumulate(np.where(split, index, 0))
        rank[open_places] = base + inner - begin
        alone = split & np.append(split[1:], True)
        open_places = open_places[~alone]
        ahead *= 2
    return order


def common(a: np.ndarray, b: np.ndarray, key: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``."""
    length = np.zeros(len(a), np.int64)
    index = np.arange(len(a))
    while len(index):
        left, right = key[a[index] + length[index]], key[b[index] + length[index]]
        same = (left == right) & ((left & ((1 << SYMBOL_BITS) - 1)) != 0)
        rest = ~same
        # Equal symbols before the first difference or separator.
        x, y, more = left[rest], right[rest], np.zeros(int(rest.sum()), np.int64)
        live = np.ones(len(x), bool)
        for i in range(PACKED):
            shift = SYMBOL_BITS * (PACKED - 1 - i)
            one, two = x >> shift & 511, y >> shift & 511
            live &= (one == two) & (one > 0)
            more += live
        length[index[rest]] += more
        index = index[same]
        length[index] += PACKED
    return length


class RunIndex:
    """Runs of the transform of all pieces, and what is sampled at their ends.

    The symbol before each suffix, in suffix order, makes runs, long ones where
    the text repeats. For the first suffix of a run the index keeps its place
    and what it has in common with the suffix before it; for the last, with the
    one after it. Inside a run, the same neighbours stood one symbol earlier:
    what a place has in common with its neighbour is one less than at the place
    before. So the samples are all that is needed.
    """

    def __init__(self, symbols: np.ndarray):
        key = packed(symbols)
        order = suffix_order(symbols, key)
        before = symbols[order - 1]  # order 0 meets the last separator
        differs = np.ones(len(order), bool)
        differs[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads = np.flatnonzero(differs)
        tails = np.append(heads[1:], len(order)) - 1
        self.symbols, self.starts = before[heads], heads
        self.head_at, self.tail_at = order[heads], order[tails]
        self.head_common = np.zeros(len(heads), np.int64)
        self.tail_common = np.zeros(len(heads), np.int64)
        shared = common(order[heads[1:] - 1], self.head_at[1:], key, symbols)
        self.head_common[1:] = shared
        self.tail_common[:-1] = shared

    def stream(self, n: int) -> np.ndarray:
        """Longest match of each place with any other place, in text order."""
        best = np.zeros(n, np.int64)
        for at, value in ((self.head_at, self.head_common), (self.tail_at, self.tail_common)):
            sampled = np.full(n, -1, np.int64)
            sampled[at] = at
            last = np.maximum.accumulate(sampled)
            values = np.zeros(n, np.int64)
            values[at] = value
            np.maximum(best, np.where(last >= 0, values[last] - (np.arange(n) - last), 0), out=best)
        return best


def index_batches(batches, window: int):
    """Mark windows of the partition's bodies that occur at another place too.

    Bodies that stand for several equal ones are marked elsewhere; here they
    are only matched against.
    """
    rows = [
        row
        for batch in batches
        for row in zip(*(batch.column(n).to_pylist() for n in ("row", "first", "count", "text", "alone")))
    ]
    if not rows:
        return
    rows.sort(key=lambda r: r[:2])
    cells = [r[:4] for r in rows]
    pieces = cells_kernel.Pieces(cells, window)
    parts = []
    for found in pieces.pieces:
        raw = np.frombuffer(b"".join(found), np.uint8).astype(np.int16) + 1
        parts += [raw, np.zeros(1, np.int16)]
    symbols = np.concatenate(parts)
    # A separator stands after each piece: places move by the pieces before.
    pieces.at = [at + number for at, number in zip(pieces.at, pieces.piece_of)]
    matches = RunIndex(symbols).stream(len(symbols))
    chosen = [i for i, r in enumerate(rows) if r[4]]
    pieces.at = [pieces.at[i] for i in chosen]
    yield cells_kernel.spans_of(matches >= window, [cells[i] for i in chosen], pieces, window)
