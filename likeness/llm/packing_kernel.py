"""Token ids of texts, cut into pieces, inside Spark tasks; and the packing plan.

Pickled by value: executors need numpy, pyarrow and tokenizers only.
"""

from __future__ import annotations

import heapq
import os
import struct
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from likeness.llm.bpe_kernel import byte_alphabet

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ID = "<u4"
ID_BYTES = 4
# Stretches without white space that a worker remembers from the latest texts
# and, once more, from those before: some 200 bytes each.
HELD_RUNS = 500_000
# Longer stretches are forgotten at once.
HELD_BYTES = 64
# Bytes of a long text that are split into stretches at a time.
SEGMENT = 4 << 20
# Pieces and bytes of ids handed on at a time.
BATCH_PIECES = 1_000
BATCH_BYTES = 8 << 20

# What a word may be cut from: ASCII symbols, but for those that begin a
# contraction or a special token.
SYMBOLS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<")
LAST_LATIN = "\u0250"


def plain_word(run: bytes) -> bool:
    """Lower-case letters only, of the Latin blocks: one word that nothing is to be done to."""
    if run.isalpha():
        return run.islower()
    text = run.decode("utf-8", "replace")
    return text.isalpha() and max(text) < LAST_LATIN and text == text.lower() and unicodedata.is_normalized("NFC", text)


class Runs(dict):
    """The ids of stretches of text between ASCII white space.

    A tokenizer of the kind used here drops white space, matches nothing across
    it, folds case, never joins a letter or digit with the symbols around it,
    and takes a run of letters as one word. So a text has the ids of its stretches,
    and a plain word those of the merges alone.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.shown = str.maketrans({chr(byte): shown for shown, byte in byte_alphabet().items()})
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, run: bytes) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            word = run.strip(SYMBOLS)
            if len(word) < len(run) and (word.isalnum() or plain_word(word)):
                at = run.index(word)
                parts = (run[:at], word, run[at + len(word) :])
                return self._held(run, b"".join(self[part] for part in parts if part))
            if plain_word(run):
                found = [token.id for token in self.model.tokenize(run.decode("latin-1").translate(self.shown))]
            else:
                found = self.tokenizer.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        return self._held(run, ids)

    def _held(self, run: bytes, ids: bytes) -> bytes:
        if len(run) <= HELD_BYTES:
            if len(self) >= HELD_RUNS:
                self.old = dict(self)
                self.clear()
            self[run] = ids
        return ids

    def ids(self, raw: bytes) -> bytes:
        if b"<" not in raw:  # special tokens are told by their case
            raw = raw.lower()
        return b"".join(b"".join(map(self.__getitem__, part.split())) for part in segments(raw))


def segments(raw: bytes):
    """A long text cut at blanks and line ends; parts exceed ``SEGMENT`` only for want of them."""
    at = 0
    while at < len(raw):
        end = at + SEGMENT
        if end < len(raw):
            cut = max(raw.rfind(b" ", at + 1, end), raw.rfind(b"\n", at + 1, end))
            if cut < 0:
                cut = min((x for x in (raw.find(b" ", end), raw.find(b"\n", end)) if x >= 0), default=len(raw))
            end = cut
        yield raw[at:end]
        at = end


PIECES = [
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("ids", pa.binary()),
]

# Built once for each worker and tokenizer.
_runs: dict[int, Runs] = {}


def piece_batches(batches, shared, last_id: int, size: int, kind: pa.DataType):
    """``(doc_id, text)`` to pieces of at most ``size`` ids; each text ends with ``last_id``."""
    if shared.id not in _runs:
        _runs.clear()
        _runs[shared.id] = Runs(shared.value)
    runs = _runs[shared.id]
    schema = pa.schema([("doc_id", kind), *PIECES])
    end = np.array([last_id], ID).tobytes()
    out, held = [], 0

    def batch_of(rows):
        columns = list(zip(*rows)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            ids = runs.ids(text.as_py() or b"") + end
            total = len(ids) // ID_BYTES
            for start in range(0, total, size):
                part = ids[start * ID_BYTES : (start + size) * ID_BYTES]
                out.append((doc_id.as_py(), start, len(part) // ID_BYTES, total, part))
                held += len(part)
                if len(out) >= BATCH_PIECES or held >= BATCH_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
    yield batch_of(out)


# Pieces of a length from ``rank`` on go, one each, to the sequences from
# ``sequence`` on, behind ``offset`` ids.
PLAN = ("length", "rank", "count", "sequence", "offset")


def plan(histogram: dict[int, int], size: int) -> np.ndarray:
    """Shortest-pack-first over lengths: rows of ``PLAN``, in order of length and rank.

    Lengths are placed from the longest to the shortest, each piece into the
    sequence with the most room. Sequences with as much room go together: what
    counts is how many there are, so the work does not grow with the pieces. A
    length that fits nowhere opens sequences and fills them.
    """
    if histogram and not 1 <= min(histogram) <= max(histogram) <= size:
        raise ValueError(f"lengths have to be 1 to {size}")
    rows: list[tuple[int, int, int, int, int]] = []
    open_packs: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence, how many
    rooms: list[int] = []
    opened = 0

    def add(room: int, first: int, count: int):
        if room and count:
            if room not in open_packs:
                open_packs[room] = []
                heapq.heappush(rooms, -room)
            packs = open_packs[room]
            if packs and packs[-1][0] + packs[-1][1] == first:
                packs[-1] = (packs[-1][0], packs[-1][1] + count)
            else:
                packs.append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while rank < n:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                packs = open_packs[room]
                while packs and rank < n:
                    first, count = packs.pop()
                    used = min(count, n - rank)
                    rows.append((length, rank, used, first, size - room))
                    rank += used
                    add(room - length, first, used)
                    if used < count:
                        packs.append((first + used, count - used))
                if not packs:
                    del open_packs[room]
                    heapq.heappop(rooms)
            else:
                fit = size // length
                for packs, deep in (((n - rank) // fit, fit), (1, (n - rank) % fit)):
                    if not packs or not deep:
                        continue
                    for i in range(deep):
                        rows.append((length, rank, packs, opened, i * length))
                        rank += packs
                    add(size - deep * length, opened, packs)
                    opened += packs
    return np.array(sorted(rows), np.int64).reshape(-1, len(PLAN))


def slices(table: np.ndarray, most: int) -> list[np.ndarray]:
    """Whole lengths of a plan, ``most`` rows together or one length."""
    starts = np.flatnonzero(np.diff(table[:, 0], prepend=-1)).tolist()
    out, begin = [], 0
    for at, end in zip(starts, [*starts[1:], len(table)]):
        if end - begin > most and at > begin:
            out.append(table[begin:at])
            begin = at
    return [*out, table[begin:]]


_RANK_BITS = 50  # beside 13 bits of a length


def place_batch(lengths: pa.Array, ranks: pa.Array, table: np.ndarray) -> pa.Array:
    key = table[:, 0] << _RANK_BITS | table[:, 1]
    length, rank = lengths.to_numpy(), ranks.to_numpy()
    row = table[np.searchsorted(key, length << _RANK_BITS | rank, side="right") - 1]
    return pa.StructArray.from_arrays([pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], ["sequence_id", "offset"])
