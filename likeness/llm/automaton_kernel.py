"""Suffix automata over words, inside Spark tasks.

Pickled by value, with ``cells_kernel``: executors need numpy and pyarrow only.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from likeness.llm import cells_kernel

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Automaton:
    """The suffix automaton of what it has read; reading tells what it knew.

    A state is a set of strings that end at the same places; ``link`` leads to
    the longest suffix that ends at more places. After a symbol is read, the
    link of the newest state is the longest suffix of the text that had ended
    before as well: the matching statistic of the place.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def read(self, symbol) -> int:
        follow, link, length = self.next, self.link, self.length
        state = len(follow)
        follow.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        at = self.last
        self.last = state
        while at >= 0 and symbol not in follow[at]:
            follow[at][symbol] = state
            at = link[at]
        if at < 0:
            return 0
        target = follow[at][symbol]
        if length[at] + 1 == length[target]:
            link[state] = target
            return length[target]
        copy = len(follow)
        follow.append(follow[target].copy())
        length.append(length[at] + 1)
        link.append(link[target])
        while at >= 0 and follow[at].get(symbol) == target:
            follow[at][symbol] = copy
            at = link[at]
        link[target] = link[state] = copy
        return length[copy]


def index_batches(batches, window: int):
    """Mark windows of the partition's bodies that also start earlier.

    Pieces are read in order of row and place, with a symbol of its own after
    each.
    """
    rows = [
        row
        for batch in batches
        for row in zip(*(batch.column(n).to_pylist() for n in ("row", "first", "count", "text")))
    ]
    if not rows:
        return
    rows.sort(key=lambda r: r[:2])
    cells = [(row, first, count, text.split(b" ")) for row, first, count, text in rows]
    pieces = cells_kernel.Pieces(cells, window)
    automaton = Automaton()
    known = []
    for number, found in enumerate(pieces.pieces):
        known += [automaton.read(word) for part in found for word in part]
        automaton.read(number)
    matched = np.array(known) >= window
    # The match ends at the last unit of the window.
    starts = np.zeros(len(matched), bool)
    starts[: len(matched) - window + 1] = matched[window - 1 :]
    yield cells_kernel.spans_of(starts, cells, pieces, window)
