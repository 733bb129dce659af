"""Windows of texts cut into cells by their anchors, inside Spark tasks.

A window is L consecutive units of one text, a unit a byte or a word. Its
anchor is the gram of k units with the least hash, the leftmost such: it
depends on the window's content alone. A cell is a run of neighbouring windows
with one anchor, so every window is in one cell, and equal windows, wherever
they are, have equal anchors at equal offsets.

Pickled by value: executors need numpy, pyarrow and xxhash only.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Units hashed in one numpy pass. Places take PLACE_BITS of a 64-bit key.
PASS_UNITS = 1 << 19
PLACE_BITS = 24
PLACE = np.uint64((1 << PLACE_BITS) - 1)
BASE = 0x9E3779B97F4A7C15  # any odd number


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


# Powers of BASE and of its inverse, made in each task and not sent to it.
_powers: dict[int, np.ndarray] = {}


def powers_of(base: int) -> np.ndarray:
    if base not in _powers:
        _powers[base] = powers(base, PASS_UNITS * 2)
    return _powers[base]


BYTE_HASH = np.random.default_rng(400).integers(0, 1 << 64, 256, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw_text(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


class Bytes:
    """The bytes of a text in UTF-8."""

    def __init__(self, text: str | bytes | None):
        self.line = raw_text(text)
        self.n = len(self.line)

    def hashes(self) -> np.ndarray:
        return BYTE_HASH[np.frombuffer(self.line, np.uint8)]

    def body(self, first: int, end: int) -> bytes:
        return self.line[first:end]


class Words:
    """What lies between ASCII white space."""

    def __init__(self, text: str | bytes | None):
        self.words = raw_text(text).split()
        self.line = b" ".join(self.words)
        self.n = len(self.words)
        lengths = np.fromiter(map(len, self.words), np.int64, self.n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def hashes(self) -> np.ndarray:
        return np.array(list(map(xxhash.xxh3_64_intdigest, self.words)), np.uint64)

    def body(self, first: int, end: int) -> bytes:
        return self.line[self.starts[first] : self.ends[end - 1]]


UNITS = {"bytes": Bytes, "words": Words}
UNIT_BYTES = {"bytes": 1, "words": 6}


def expected_cells(unit: str, n_bytes: int, window: int, gram: int) -> int:
    """About how many cells so many bytes give: one for half the places an anchor may have."""
    return 2 * n_bytes // UNIT_BYTES[unit] // (window - gram + 2)


def cut(hashes: np.ndarray, text_of: np.ndarray, window: int, gram: int):
    """First window, number of windows, anchor place and anchor hash of each cell."""
    n = len(hashes)
    starts = n - window + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers_of(BASE)[:n], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * powers_of(inverse(BASE))[: n - gram + 1])
    # Least hash first, then leftmost place, over spans of equal length: the
    # least of a block's tail and the next block's head.
    span = window - gram + 1
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.append(key, np.full(-len(key) % span, ~np.uint64(0))).reshape(-1, span)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tails[:starts], heads[span - 1 : span - 1 + starts])
    anchor = (least & PLACE).astype(np.int64)
    inside = text_of[:starts] == text_of[window - 1 :]
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (text_of[1:starts] != text_of[: starts - 1])
    first = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= begins[1:] | ~inside[1:]
    count = np.flatnonzero(stops) + 1 - first
    return first, count, anchor[first], grams[anchor[first]]


CELLS = pa.schema(
    [
        ("anchor", pa.int64()),
        ("body", pa.int64()),
        ("row", pa.int64()),
        ("piece", pa.int32()),
        ("alone", pa.bool_()),
        ("first", pa.int32()),
        ("count", pa.int32()),
    ]
)


def cell_batches(batches, unit: str, window: int, gram: int, anchors_only: bool = False):
    """Cells of ``(row, piece, alone, text)``: anchor, digest of the cell's units, place; or just anchors."""
    held: list[tuple[tuple, int, object, np.ndarray]] = []
    size = 0

    def run():
        lengths = [len(h) for *_, h in held]
        offsets = np.cumsum([0, *lengths])
        text_of = np.repeat(np.arange(len(held)), lengths)
        first, count, anchor, found = cut(np.concatenate([h for *_, h in held]), text_of, window, gram)
        if anchors_only:
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["anchor"])
        which = text_of[first]
        inner = first - offsets[which]
        base = np.array([b for _, b, _, _ in held])[which] if len(first) else first
        rows, pieces, alone = (np.array(x)[which] for x in zip(*(p for p, *_ in held)))
        begin = inner + base
        digest = xxhash.xxh3_64_intdigest
        bodies = [
            digest(held[w][2].body(b, b + c + window - 1), o)
            for w, b, c, o in zip(which.tolist(), begin.tolist(), count.tolist(), (anchor - first).tolist())
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found.view(np.int64)),
                pa.array(np.array(bodies, np.uint64).view(np.int64)),
                pa.array(rows, pa.int64()),
                pa.array(pieces, pa.int32()),
                pa.array(alone, pa.bool_()),
                pa.array((pieces + begin).astype(np.int32)),
                pa.array(count.astype(np.int32)),
            ],
            schema=CELLS,
        )

    for batch in batches:
        for *place, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            units = UNITS[unit](text.as_py())
            if units.n < window:
                continue
            hashes = units.hashes()
            # A very long text goes in pieces that share window - 1 units, so
            # that each window is in one of them.
            for base in range(0, units.n - window + 1, PASS_UNITS):
                piece = hashes[base : base + PASS_UNITS + window - 1]
                held.append((place, base, units, piece))
                size += len(piece)
                if size >= PASS_UNITS // 2:
                    yield run()
                    held, size = [], 0
    if held:
        yield run()


# Bodies handed on at a time.
BODY_ROWS = 4_000
BODIES = pa.schema([f for f in CELLS if f.name != "body"]).append(pa.field("text", pa.binary()))


def body_batches(batches, unit: str, window: int):
    """Bodies of wanted cells: ``(row, piece, text, wanted)`` to one row for each."""
    rows: list[dict] = []
    for batch in batches:
        for row, piece, text, wanted in zip(*(batch.column(i) for i in range(4))):
            units = UNITS[unit](text.as_py())
            place = {"row": row.as_py(), "piece": piece.as_py()}
            for cell in wanted.as_py():
                begin = cell["first"] - place["piece"]
                rows.append(cell | place | {"text": units.body(begin, begin + cell["count"] + window - 1)})
                if len(rows) == BODY_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, BODIES)
                    rows = []
    yield pa.RecordBatch.from_pylist(rows, BODIES)


# A mark up to here goes to the end of its text, if that has a window.
END = -1
MARKS = pa.schema([("row", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])


class Pieces:
    """Bodies put end to end, each unit of a text once.

    ``cells`` are (row, first, count, units) in order of row and first; bodies
    of a text that overlap or meet are one piece.
    """

    def __init__(self, cells, window: int):
        self.pieces: list = []
        self.at: list[int] = []  # place of each cell's first unit, without separators
        self.piece_of: list[int] = []
        self.starts: list[tuple[int, int]] = []
        row_now, end_now, total = None, -1, 0
        for row, first, count, units in cells:
            end = first + count + window - 1
            if row != row_now or first > end_now:
                self.pieces.append([units])
                self.starts.append((first, total))
                row_now, end_now = row, end
                total += len(units)
            elif end > end_now:
                self.pieces[-1].append(units[end_now - first :])
                total += end - end_now
                end_now = end
            self.piece_of.append(len(self.pieces) - 1)
            begin, offset = self.starts[-1]
            self.at.append(offset + first - begin)


def spans_of(long_starts: np.ndarray, cells, pieces: Pieces, window: int):
    """Marks of the cells: ``long_starts`` tells for each unit whether its window counts."""
    rows, begins, ends = [], [], []
    for (row, first, count, _), at in zip(cells, pieces.at):
        found = np.flatnonzero(np.diff(long_starts[at : at + count].astype(np.int8), prepend=0, append=0))
        for a, b in found.reshape(-1, 2).tolist():
            rows.append(row)
            begins.append(first + a)
            ends.append(first + b - 1 + window)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], schema=MARKS
    )


def merged(spans: list[dict] | None, n: int, window: int) -> list[list[int]]:
    """Spans in order, those that meet as one."""
    if any(s["to"] == END for s in spans or []):
        return [[0, n]] if n >= window else []
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
CUT = pa.struct([("n", pa.int64()), ("spans", SPANS), ("kept", pa.binary())])


def cut_batch(texts: pa.Array, marks: pa.Array, unit: str, window: int) -> pa.Array:
    """Number of units, merged marks, and what stays of each text."""
    rows = []
    for text, found in zip(texts, marks):
        units = UNITS[unit](text.as_py())
        spans = merged(found.as_py(), units.n, window)
        kept, at = [], 0
        source = units.line if unit == "bytes" else units.words
        for a, b in spans:
            kept += [source[at:a]] if unit == "bytes" else source[at:a]
            at = b
        kept += [source[at:]] if unit == "bytes" else source[at:]
        rows.append(
            {
                "n": units.n,
                "spans": [{"from": a, "to": b} for a, b in spans],
                "kept": (b"" if unit == "bytes" else b" ").join(kept),
            }
        )
    return pa.array(rows, CUT)
