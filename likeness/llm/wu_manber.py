"""Wu-Manber search of many word windows in one text, run inside Spark tasks.

Pickled by value: executors need numpy and pyarrow only.
"""

from __future__ import annotations

import pickle
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes in a block of the shift tables, where patterns are long enough.
BLOCK = 8
# A-Z to lower case; what is no word byte to a blank.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(item: list[bytes], size: int) -> set[bytes]:
    """Every window of ``size`` words, or the whole of a shorter item."""
    if not item:
        return set()
    return {b" ".join(item[i : i + size]) for i in range(max(1, len(item) - size + 1))}


class Patterns:
    """Tables for one class of patterns of like length.

    Patterns are blank, words joined by one blank, blank: they meet whole words
    only. ``shift`` says how far the end of the search window may move for the
    block of bytes it ends with; blocks unknown allow the longest move. Where it
    says 0, ``suffix`` has the patterns whose first ``reach`` bytes end with the
    block.
    """

    def __init__(self, patterns: list[bytes]):
        self.reach = min(map(len, patterns))
        self.block = min(BLOCK, self.reach)
        self.skip = self.reach - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.suffix: dict[bytes, list[bytes]] = defaultdict(list)
        for pattern in patterns:
            for end in range(self.block, self.reach + 1):
                block = pattern[end - self.block : end]
                move = self.reach - end
                if move < self.shift.get(block, self.skip):
                    self.shift[block] = move
            self.suffix[pattern[self.reach - self.block : self.reach]].append(pattern)

    def find(self, text: bytes):
        """Yield ``(start, pattern)`` of every occurrence, overlapping ones too."""
        shift, skip, block, reach = self.shift.get, self.skip, self.block, self.reach
        end, last = reach, len(text)
        while end <= last:
            tail = text[end - block : end]
            move = shift(tail, skip)
            if move:
                end += move
                continue
            start = end - reach
            for pattern in self.suffix[tail]:
                if text.startswith(pattern, start):
                    yield start, pattern
            end += 1


class Searcher:
    """All patterns of a slice of test items, by length class."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        classes = defaultdict(list)
        for item_id, text in items:
            found = words(text)
            for one in windows(found, window):
                pattern = b" " + one + b" "
                if pattern not in self.items:
                    full = len(found) >= window
                    classes[0 if full else len(pattern).bit_length()].append(pattern)
                self.items[pattern] |= set() if item_id is None else {item_id}
        self.classes = [Patterns(found) for found in classes.values()]

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words of the text, its hit words as spans of word numbers, item ids."""
        found = words(text)
        if not found:
            return 0, [], []
        line = b" " + b" ".join(found) + b" "
        hits = [hit for patterns in self.classes for hit in patterns.find(line)]
        if not hits:
            return len(found), [], []
        blanks = np.cumsum(np.frombuffer(line, np.uint8) == 32)
        spans = sorted(
            (int(blanks[at]) - 1, int(blanks[at + len(p) - 1]) - 1) for at, p in set(hits)
        )
        ids = set().union(*(self.items[p] for _, p in hits))
        return len(found), merged(spans), sorted(ids)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that meet or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("item_ids", pa.list_(pa.string()))]
)


def opened(shared):
    """The object of a broadcast that holds it pickled by value, as ``sealed`` makes it.

    A plain broadcast names classes and would need this package on executors.
    The object stays with the broadcast, from task to task of a worker.
    """
    held = shared.value
    if "object" not in held:
        held["object"] = pickle.loads(held["pickled"])
    return held["object"]


def sealed(value) -> dict:
    return {"pickled": cloudpickle.dumps(value)}


def search_batch(texts: pa.Array, shared) -> pa.Array:
    rows, searcher = [], opened(shared)
    for text in texts:
        n, spans, ids = searcher.search(text.as_py())
        rows.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "item_ids": ids})
    return pa.array(rows, FOUND)


def merge_batch(spans: pa.Array) -> pa.Array:
    rows = []
    for row in spans.to_pylist():
        found = merged(sorted((s["start"], s["end"]) for s in row or []))
        rows.append([{"start": a, "end": b} for a, b in found])
    return pa.array(rows, pa.list_(SPAN))
