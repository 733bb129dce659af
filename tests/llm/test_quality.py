import math
import random
from collections import Counter

from likeness.llm import quality
from likeness.llm.quality_kernel import base_counts


def plain_counts(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
    }


def test_counts_against_brute_force():
    rnd = random.Random(7)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b", "é", " ", " ", " ", "\n", "#", "\x1c", "\x0b", "😀"]) for _ in range(rnd.randrange(80)))
        assert base_counts(text.encode())[0] == plain_counts(text), repr(text)


def prose(rnd, n, words=("the", "of", "and", "to", "a", "in", "is")):
    rare = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9)))
    return " ".join(rnd.choice(words) if rnd.random() < 0.5 else rare() for _ in range(n))


def test_divergence_and_edges(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, 200), "xx", 0) for i in range(150)]
    junk = [
        (900, " ".join(w.upper() + "!!" for w in prose(rnd, 200).split()), "xx", 0),
        (901, " ".join(w + "%%%" for w in prose(rnd, 200).split()), "xx", 0),
    ]
    edge = [
        (1000, None, "xx", 0),
        (1001, "", None, 0),
        (1002, "few words", None, 0),
        (1003, prose(rnd, 300), "rare language", 0),
        (1004, "same words again " * 100, "xx", 0),
        (None, rows[0][1], "xx", 0),
        (0, rows[0][1], "xx", 0),
        (1005, prose(rnd, 60_000), "xx", 0),
    ]
    df = spark.createDataFrame(rows + junk + edge, "doc_id long, text string, lang string, kept int").repartition(3)
    got = quality.judge(df)
    assert got.columns[:4] == df.columns
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[i] for i in range(150)) and kept[1003] and kept[None] and kept[1005]
    assert not any(kept[i] for i in (900, 901, 1000, 1001, 1002, 1004))
    assert got.count() == df.count()
    assert quality.judge(df.limit(0)).count() == 0


def test_copies_and_failed_texts_do_not_make_the_reference(spark):
    rnd = random.Random(14)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    chances = [1 / (i + 1) for i in range(3000)]

    def natural(n):
        return " ".join(rnd.choices(vocabulary, chances, k=n))

    hot = " ".join(rnd.choices(vocabulary[1000:1040], k=1000))
    clean = [(i, natural(1000), "xx") for i in range(60)]
    copies = [(1000 + i, hot, "xx") for i in range(120)]
    poor = [(2000 + i, "spam words only " * 400, "xx") for i in range(60)]
    df = spark.createDataFrame(clean + copies + poor, "doc_id long, text string, lang string").repartition(5)
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert len(kept) == 240 and all(kept[i] for i in range(60)) and not any(kept[2000 + i] for i in range(60))
    counts = {r._lang: r.n_words for r in quality.references(df).collect()}
    assert counts == {"=xx": 61_000}


def plain_references(rows, common):
    """Each different text of a language once, if it passes the base rules."""
    words, classes, seen = {}, {}, set()
    for lang, text in rows:
        counts = plain_counts(text or "")
        n = counts["n_words"]
        if (lang, text) in seen or n < 50 or 100 * counts["n_repeat_words"] > 50 * n:
            continue
        seen.add((lang, text))
        raw = text.encode()
        words.setdefault(lang, Counter()).update(raw.lower().decode().split())
        classes[lang] = classes.get(lang, 0) + quality.kernel.class_counts(raw)
    out = {}
    for lang, found in words.items():
        top = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:common]
        out["" if lang is None else f"={lang}"] = (
            sum(found.values()), [w for w, _ in top], [n for _, n in top], classes[lang].tolist()
        )
    return out


def corpus(rnd):
    rows = [("xx", prose(rnd, rnd.randrange(40, 300))) for _ in range(60)]
    rows += [("xx", rows[0][1])] * 30 + [("flat", " ".join(rnd.sample([f"w{i}" for i in range(900)], 800))) for _ in range(3)]
    rows += [(None, prose(rnd, 120)), ("", prose(rnd, 90)), ("yy", None), ("yy", ""), ("zz", "same words " * 90)]
    return rows


def test_references_against_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(21))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    expected = plain_references(rows, 50)
    assert set(expected) == {"=xx", "=flat", "", "="}
    shapes = ({}, {"CANDIDATES": 1, "WHOLE": 1, "REPORTED": 1}, {"BROADCAST_LANGUAGES": 0, "LANGUAGE_PARTS": 3})
    for shape in shapes:
        with monkeypatch.context() as patch:
            for name, value in shape.items():
                patch.setattr(quality, name, value)
            found = quality.references(df).collect()
        assert {r._lang: (r.n_words, r.words, r.counts, r.classes) for r in found} == expected


def plain_distance(p, q):
    p, q = ([x / sum(h) for x in h] for h in (p, q))
    total = sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q) if a)
    total += sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q) if b)
    return math.sqrt(max(0.0, total / 2))


def plain_verdicts(rows):
    """``(base_failed, kept)`` of each ``(lang, text)``."""
    table = plain_references(rows, 50)
    pooled = [sum(t[3][i] for t in table.values()) for i in range(8)]
    pool = lambda h: [h[0] + h[1] + h[7], *h[2:7]]
    slack = lambda limit, *sizes: limit[0] + sum(limit[1] / math.sqrt(x) for x in sizes)
    verdicts = []
    for lang, text in rows:
        counts = plain_counts(text or "")
        n = counts["n_words"]
        if n < 50 or 100 * counts["n_repeat_words"] > 50 * n:
            verdicts.append((True, False))
            continue
        raw = text.encode()
        total, words, uses, classes = table["" if lang is None else f"={lang}"]
        own = Counter(raw.lower().decode().split())
        histogram = [own[w] for w in words]
        found = quality.kernel.class_counts(raw).tolist()
        kept = (
            plain_distance([*histogram, n - sum(histogram)], [*uses, total - sum(uses)]) <= slack(quality.WORD_LIMIT, n, total)
            and plain_distance(found, classes) <= slack(quality.CLASS_LIMIT, n, total)
            and plain_distance(pool(found), pool(pooled)) <= slack(quality.POOLED_LIMIT, n)
        )
        verdicts.append((False, kept))
    return verdicts


def test_verdicts_against_brute_force(spark):
    rnd = random.Random(22)
    junk = " ".join(w + "%%%" for w in prose(rnd, 200).split())
    rows = corpus(rnd) + [("xx", junk), ("junk", "#%& " * 5 + " ".join("|%$#" + str(i) for i in range(90)))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(df).collect()}
    assert [got[i] for i in range(len(rows))] == plain_verdicts(rows)
    # A language of its own hides no junk.
    assert not got[len(rows) - 1][1] and not got[len(rows) - 2][1]
