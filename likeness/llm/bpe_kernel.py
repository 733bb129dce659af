"""Byte-pair encoding of one batch of texts, run inside Spark tasks.

The encoder never merges. It takes the longest token at a place (all matches
of a word come from one Aho-Corasick pass), keeps it if it may follow the token
before it, and otherwise tries the next shorter token or steps back. A pair may
stand side by side exactly when no merge across its border would have come
before the merges that made its two sides. Places known to lead nowhere are
marked, so the work is linear in the word.

Pickled by value: executors need numpy, pyarrow, regex and pyahocorasick only.
"""

from __future__ import annotations

import json
import pickle
import struct
import sys
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Stands for the end-of-word mark inside byte strings; no UTF-8 text has it.
END = b"\xff"
# Words that a task keeps from the latest texts and, once more, from those
# before: some 170 bytes each.
CACHED = 120_000
CACHED_PAIRS = 200_000

# Unicode white space, as the pre-tokenizer's \s takes it.
SPACE = r"\t-\r \x85\xa0  -     　"
# The pre-tokenizer's pattern.
WORD = regex.compile(
    rf"\p{{L}}+|\p{{N}}|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}\p{{L}}\p{{N}}]+"
)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tables:
    """What encoder and decoder need of a tokenizer file; pickles to a few MB."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        vocab = model["vocab"]

        def raw(token: str) -> bytes:
            ends = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            return bytes(alphabet[c] for c in body) + (END if ends else b"")

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pair_rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        self.rank = {vocab[a + b]: rank for rank, (a, b) in enumerate(merges)}
        if len(self.parts) != len(merges):
            raise ValueError("two merges make the same token: its rank is not unique")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Byte 0xFF stands in no text, so neither do tokens that hold it.
        self.bytes_of = {
            i: raw(token)
            for token, i in vocab.items()
            if token not in self.specials and "ÿ" not in token
        }
        # A token that the merges never build from its own bytes cannot occur.
        for token in sorted(self.parts, key=self.rank.__getitem__):
            left, right = self.parts[token]
            if not (left in self.bytes_of and right in self.bytes_of) or not self.adjacent(
                left, right, self.rank[token]
            ):
                del self.bytes_of[token]
        ids = {b: i for i, b in self.bytes_of.items()}
        self.shorter = {
            i: next((ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ids), None)
            for i, b in self.bytes_of.items()
        }
        names = {i: token for token, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        texts = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.offsets = np.cumsum([0, *map(len, texts)])
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def adjacent(self, left: int, right: int, own: int | None = None) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side.

        Undoes the later of the last merges on either side, step by step; a
        merge across the border breaks the pair if it comes before the step
        just undone. ``own`` asks for the moment before that merge instead of
        the end.
        """
        rank, parts, pairs = self.rank, self.parts, self.pair_rank
        # (limit, ties): a crossing merge counts below limit.
        limit = len(pairs) if own is None else own
        while True:
            crossing = pairs.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            left_rank, right_rank = rank.get(left, -1), rank.get(right, -1)
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank > right_rank:
                # While the right side of a pair waits, an equal rank on its
                # left has already been taken: merges run from left to right.
                limit, left = left_rank, parts[left][1]
            else:
                limit, right = right_rank + 1, parts[right][0]

    def matcher(self):
        """Finds all tokens in a text; tells their length less one, and their id."""
        found = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            found.add_word(b.decode("latin-1"), (len(b) - 1, i))
        found.make_automaton()
        return found


class Codec:
    """Encodes and decodes with tables; remembers the words it has seen lately."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.matches = tables.matcher()
        count = len(tables.offsets) - 1
        self.size = [len(tables.bytes_of.get(i, b"")) for i in range(count)]
        self.shorter = [tables.shorter.get(i) for i in range(count)]
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        self.border: dict[int, bool] = {}  # by left << 32 | right
        marks = sorted(map(regex.escape, tables.specials), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(marks) + ")") if marks else None

    def fits(self, pair: int) -> bool:
        if len(self.border) > CACHED_PAIRS:
            self.border.clear()
        answer = self.border[pair] = self.tables.adjacent(pair >> 32, pair & 0xFFFFFFFF)
        return answer

    def word(self, word: str) -> list[int]:
        """Token ids of one word of the pre-tokenizer."""
        line = (word if word.isascii() else word.encode().decode("latin-1")) + "\xff"
        n = len(line)
        longest: list[int | None] = [None] * n
        for end, (less, token) in self.matches.iter(line):
            longest[end - less] = token  # later ends are longer tokens
        size, shorter, border = self.size, self.shorter, self.border
        dead: set[int] = set()
        tokens: list[int] = []
        place, last, token = 0, None, longest[0]
        while place < n:
            while token is not None:
                after = place + size[token]
                if after not in dead:
                    if last is None:
                        break
                    pair = last << 32 | token
                    answer = border.get(pair)
                    if answer or answer is None and self.fits(pair):
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                place, last = after, token
                token = longest[place] if place < n else None
            else:
                if last is None:
                    raise ValueError(f"the vocabulary cannot spell {word!r}")
                dead.add(place)
                tokens.pop()
                place -= size[last]
                token = shorter[last]
                last = tokens[-1] if tokens else None
        return tokens

    def learn(self, words: set[str]) -> None:
        """Encode the words not yet known."""
        fresh = words.difference(self.words)
        if len(self.words) + len(fresh) > CACHED:
            self.words_before, self.words = self.words, {}
            fresh = words
        known, before = self.words, self.words_before.get
        for word in fresh:
            found = before(word)
            if found is None:
                tokens = self.word(word)
                found = struct.pack(f"<{len(tokens)}I", *tokens)
            known[word] = found

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is not None and "<" in text:
            pieces = self.special.split(text)
        else:
            pieces = [text]
        out = []
        for at, piece in enumerate(pieces):
            if at % 2:
                out.append(self.tables.specials[piece].to_bytes(4, "little"))
                continue
            words = WORD.findall(normalised(piece))
            self.learn(set(words))
            out += map(self.words.__getitem__, words)
        return b"".join(out)

    def text(self, ids: bytes) -> bytes:
        """Token texts joined by one space, gathered through the offset table."""
        found = np.frombuffer(ids, "<u4")
        if not len(found):
            return b""
        starts = self.tables.offsets[found]
        lengths = self.tables.offsets[found + 1] - starts
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self.tables.text[index].tobytes()[:-1]


def normalised(text: str) -> str:
    """NFC, then lower case by character.

    White space needs no folding: the pattern drops it.
    """
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # str.lower() looks at the neighbours of a capital sigma
        text = text.replace("Σ", "σ")
    return text.lower()


def opened(shared):
    """The codec of a broadcast that holds its tables pickled by value, as ``sealed`` makes it.

    A plain broadcast names classes and would need this package on executors.
    The codec stays with the broadcast, from task to task of a worker.
    """
    held = shared.value
    if "codec" not in held:
        held["codec"] = Codec(pickle.loads(held["pickled"]))
    return held["codec"]


def sealed(value) -> dict:
    return {"pickled": cloudpickle.dumps(value)}


# Rows worked on, and handed back, at a time.
SLICE_ROWS = 200


def map_column(batches, source: str, target: str, work):
    """Each batch in slices, with the column ``target`` that ``work`` makes of ``source``."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part.append_column(target, work(part.column(source)))


def encode_batches(batches, shared, text: str):
    own = opened(shared)
    return map_column(
        batches, text, "ids", lambda texts: pa.array([own.ids(t.as_py() or "") for t in texts], pa.binary())
    )


def decode_batches(batches, shared, ids: str):
    own = opened(shared)
    return map_column(
        batches,
        ids,
        "decoded",
        lambda found: pa.array([own.text(i.as_py() or b"").decode() for i in found], pa.string()),
    )
