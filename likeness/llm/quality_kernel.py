"""Word and character counts of texts, run inside Spark tasks.

Pickled by value: executors need numpy and pyarrow only.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Distinct words a task counts before it reports the frequent ones.
HELD_WORDS = 400_000
LANGUAGES_HELD = 1_000

CLASSES = ("lower", "upper", "digit", "space", "symbol", "stop", "other", "beyond")
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?"


def class_of_byte() -> np.ndarray:
    """Class number of each byte; bytes inside a character beyond ASCII have none (-1)."""
    found = np.full(256, 6)
    found[0x61:0x7B], found[0x41:0x5B], found[0x30:0x3A] = 0, 1, 2
    found[[0x20, *range(9, 14)]] = 3
    found[list(SYMBOLS)] = 4
    found[list(STOPS)] = 5
    found[0x80:0xC0], found[0xC0:] = -1, 7
    return found


BYTE_CLASS = class_of_byte()
CLASS_MATRIX = np.stack([BYTE_CLASS == c for c in range(len(CLASSES))]).astype(np.int64)


def class_counts(raw: bytes) -> np.ndarray:
    """Characters of each class."""
    return CLASS_MATRIX @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    size = len(numbers)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 21:  # three numbers no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[which] > 1)
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[twice + shift] = True
    return int(inside.sum())


def base_counts(raw: bytes) -> tuple[dict, list[bytes], np.ndarray]:
    words = raw.split()
    classes = class_counts(raw)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    counts = {
        "n_words": len(words),
        "word_chars": int(classes.sum() - classes[3]),
        "n_symbols": int(classes[4]),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }
    return counts, words, classes


def raw_text(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


MIN_WORDS = 50


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """Too few words, or more than half of them in repeated windows."""
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def text_key(lang: str, raw: bytes) -> bytes:
    """128 bits for each text of a language."""
    name = hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return hashlib.blake2b(raw, digest_size=16, key=name).digest()


REPORT = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("texts", pa.int64())])


def report_batches(batches, most: int):
    """The ``most`` frequent words of parts of a task, by language.

    A row without a word has the count that no word left out of its part
    exceeds, and the number of texts.
    """
    words: dict[str, Counter] = {}
    texts: Counter = Counter()

    def flush():
        for lang, found in words.items():
            top = found.most_common(most + 1)
            left_out = top.pop()[1] if len(top) > most else 0
            columns = (
                [lang] * (len(top) + 1),
                [*(w.decode("utf-8", "replace") for w, _ in top), None],
                [*(n for _, n in top), left_out],
                [0] * len(top) + [texts[lang]],
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, REPORT)], schema=REPORT)
        words.clear()
        texts.clear()

    held = 0
    for batch in batches:
        for lang, text in zip(*batch.columns):
            found = words.setdefault(lang.as_py(), Counter())
            texts[lang.as_py()] += 1
            before = len(found)
            found.update(raw_text(text.as_py()).lower().split())
            held += len(found) - before
            if held > HELD_WORDS or len(words) > LANGUAGES_HELD:
                yield from flush()
                held = 0
    yield from flush()


PROFILE = pa.schema(
    [
        ("key", pa.binary()),
        ("lang", pa.string()),
        ("n_words", pa.int64()),
        ("classes", pa.list_(pa.int64())),
        ("at", pa.list_(pa.int32())),
        ("n", pa.list_(pa.int64())),
    ]
)


def indexed(known: dict, lang: str, words: str) -> dict[bytes, int]:
    if lang not in known:
        if len(known) >= LANGUAGES_HELD:
            known.clear()
        known[lang] = {w: i for i, w in enumerate(words.encode().split())}
    return known[lang]


def profile_batches(batches):
    """One narrow row for each ``(lang, text, words)`` that passes the base rules.

    Its key, and how often it has each of its language's ``words`` (only those
    that it has), each class of character, and words at all.
    """
    known: dict[str, dict[bytes, int]] = {}
    for batch in batches:
        rows = []
        for lang, text, words in zip(*batch.columns):
            raw, lang = raw_text(text.as_py()), lang.as_py()
            own = raw.split()
            if base_failed(len(own), 0) or base_failed(len(own), repeated_words(own)):
                continue
            index = indexed(known, lang, words.as_py())
            found = [i for i in map(index.get, raw.lower().split()) if i is not None]
            n = np.bincount(found) if found else np.zeros(0, np.int64)
            at = np.flatnonzero(n)
            rows.append((text_key(lang, raw), lang, len(own), class_counts(raw), at, n[at]))
        columns = list(zip(*rows)) or [[]] * len(PROFILE)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PROFILE)], schema=PROFILE)


TOTALS = pa.schema([("lang", pa.string()), ("what", pa.int32()), ("at", pa.int32()), ("n", pa.int64())])
WORDS, CLASS, ALL = range(3)


def total_batches(batches):
    """Sums of profiles, by language: of each word, each class, and all words."""
    words: dict[str, np.ndarray] = {}
    classes: dict[str, np.ndarray] = {}
    all_words: Counter = Counter()

    def flush():
        rows = [(lang, WORDS, i, n) for lang, found in words.items() for i, n in enumerate(found.tolist()) if n]
        rows += [(lang, CLASS, i, n) for lang, found in classes.items() for i, n in enumerate(found.tolist())]
        rows += [(lang, ALL, 0, n) for lang, n in all_words.items()]
        for held in (words, classes, all_words):
            held.clear()
        columns = list(zip(*rows)) or [[]] * len(TOTALS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TOTALS)], schema=TOTALS)

    for batch in batches:
        for lang, n_words, found, at, n in zip(*(batch.column(c) for c in ("lang", "n_words", "classes", "at", "n"))):
            lang = lang.as_py()
            at, n = (x.values.to_numpy() for x in (at, n))
            held = words.get(lang, np.zeros(0, np.int64))
            if len(at) and at[-1] >= len(held):
                held = np.append(held, np.zeros(int(at[-1]) + 1 - len(held), np.int64))
            held[at] += n
            words[lang] = held
            classes[lang] = classes.get(lang, 0) + found.values.to_numpy()
            all_words[lang] += n_words.as_py()
        if len(words) > LANGUAGES_HELD:
            yield flush()
    yield flush()


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2: 0 equal, 1 apart."""
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2

    def against(x):
        some = x > 0
        return float(np.sum(x[some] * np.log2(x[some] / middle[some])))

    return float(np.sqrt(max(0.0, (against(p) + against(q)) / 2)))


JUDGED = pa.struct(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("class_distance", pa.float64()),
        ("word_distance", pa.float64()),
        ("pooled_distance", pa.float64()),
    ]
)

# Classes as all languages share them: letters of any kind are one.
POOLS = np.array([[1, 1, 0, 0, 0, 0, 0, 1], *np.eye(len(CLASSES), dtype=int)[2:7]])


def judge_batch(langs: pa.Array, texts: pa.Array, references: pa.Array) -> pa.Array:
    """Base counts, and distances where there is a word and a reference."""
    known: dict = {}
    rows = []
    for lang, text, reference in zip(langs, texts, references):
        raw = raw_text(text.as_py())
        row, words, classes = base_counts(raw)
        rows.append(row)
        if not words or not reference.is_valid:
            continue
        key = lang.as_py()
        if key not in known:
            if len(known) >= LANGUAGES_HELD:
                known.clear()
            found = reference.as_py()
            index = {w.encode(): i for i, w in enumerate(found["words"])}
            rest = found["n_words"] - sum(found["counts"])
            known[key] = (
                index,
                np.array([*found["counts"], rest], float),
                np.array(found["classes"], float),
                POOLS @ np.array(found["pooled"], float),
            )
        index, common, usual, pooled = known[key]
        other = len(index)
        own = np.bincount([index.get(w, other) for w in raw.lower().split()], minlength=other + 1)
        row["word_distance"] = distance(own, common)
        row["class_distance"] = distance(classes, usual)
        row["pooled_distance"] = distance(POOLS @ classes, pooled)
    return pa.array(rows, JUDGED)
