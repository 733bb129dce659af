import hashlib
import random
import re

import numpy as np
import pytest
from test_decontaminate import plain_search
from test_packing import library
from test_pii import PLAIN, passes, plain_grow
from test_quality import plain_verdicts, prose
from test_simhash import plain_print, roots_of

import corpus_pipeline
from likeness.llm import pii
from likeness.plans.staging import stage

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SMALL), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= left
        left = docs.count()
    assert docs.filter("text LIKE '%@mail%'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == left and last.filter("n_tokens = 0").count() == 0


def test_edges(spark):
    rnd = random.Random(13)
    text = prose(rnd, 120)
    rows = [(1, text, "en", "s", 0, 0, 0), (1, text, "en", "s", 0, 0, 0), (2, None, None, None, None, 0, 0), (3, "", "en", "s", 0, 0, 0),
            (None, prose(rnd, 90), None, "s", 0, 0, 0), (4, prose(rnd, 40_000), "en", "s", 0, 0, 0), (5, text, "en", "s", 0, 0, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, spans int"
    full = spark.createDataFrame(rows, schema)
    for start in (full, full.limit(0)):
        docs = start
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = stage(step(spark, docs, SMALL), name)
            assert docs.columns == start.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
        assert sorted(str(r.doc_id) for r in out) == ([] if start is not full else ["1", "4", "None"])


def test_settings_are_restored(spark):
    name = corpus_pipeline.ARROW_ROWS
    before = spark.conf.get(name)
    assert int(before) > corpus_pipeline.BATCH_TEXTS
    with pytest.raises(KeyError):
        with corpus_pipeline.small_batches(spark):
            assert spark.conf.get(name) == str(corpus_pipeline.BATCH_TEXTS)
            raise KeyError
    assert spark.conf.get(name) == before


BENCHMARK = [("q1", "what is the name of the river that flows through the old town and ends in the sea"), ("q2", "short item here")]


def fixture():
    """Clean prose, junk, copies, near copies, contaminated texts, personal data."""
    rnd = random.Random(77)
    texts = [prose(rnd, rnd.randrange(60, 260)) for _ in range(40)]
    texts += [texts[i] for i in (0, 0, 3, 5)]
    for i in (7, 8):
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join(w + "###" for w in prose(rnd, 120).split()), "far too short", "the same again " * 60, None, ""]
    texts += [prose(rnd, 70) + " " + BENCHMARK[0][1] + " " + prose(rnd, 30), prose(rnd, 900) + " " + BENCHMARK[0][1]]
    texts += [prose(rnd, 60) + f" mail to user{i}@host{i}.example.org or +1 (555) 010-{1000 + i} " + prose(rnd, 40) for i in range(16)]
    texts += [prose(rnd, 60) + " mail to account77x now " + prose(rnd, 40), prose(rnd, 70) + ' token = "' + "0a" * 20 + '" from 10.0.0.7']
    return [(i, t, "en" if i % 9 else None, f"s{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]


def plain_left(text, start):
    passed = re.sub("[\x20\x09-\x0d]+", " ", text[:start])
    return " ".join(passed.split(" ")[-3:])


def plain_patterns(left, value):
    folded = re.sub("[0-9]", "0", left.lower())
    one = " ".join(folded.split(" ")[-2:])
    marks = "".join(sign for of, sign in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0")) if re.search(of, value))
    shape = marks + "".join(sorted(set(re.sub("[A-Za-z0-9]", "", value)))) + f":{len(value)}"
    return ([f"2 {folded}"] if folded.strip() else []) + ([f"1 {one} {shape}"] if one.strip() else [])


def plain_mask(texts):
    places, known, pairs = [], [], set()
    for number, text in enumerate(texts):
        tried = [(m.start(), m.end(), kind, m[0]) for kind, p in PLAIN.items() for m in re.finditer(p, text)]
        taken = [(a, b, kind, v) for a, b, kind, v in tried if passes(kind, v)]
        # Runs of digits that cannot be a card at all are no match of the kind.
        taken_or_refused = [(a, b) for a, b, kind, v in tried if kind != "card" or 12 <= len(re.sub("[^0-9]", "", v)) <= 19]
        free = [
            (m.start(), m.end(), None, m[0])
            for m in re.finditer(pii.CANDIDATE, text)
            if not any(a < m.end() and m.start() < b for a, b in taken_or_refused)
        ]
        for a, b, kind, value in taken + free:
            seed = kind or next((k for k, form in pii.SEEDS.items() if re.search(form, value)), None)
            places.append((number, a, b, kind, value.lower()))
            pairs |= {(p, value.lower()) for p in plain_patterns(plain_left(text, a), value)}
            if seed:
                known.append((value.lower(), seed))
    grown = plain_grow(known, sorted(pairs), pii.ROUNDS)
    spans = [[] for _ in texts]
    for number, a, b, kind, value in places:
        if kind or value in grown:
            name = kind or grown[value][0]
            spans[number].append((a, pii.ORDER.index(name), b, name))
    out = []
    for text, found in zip(texts, spans):
        at, done = 0, ""
        for a, _, b, kind in sorted(found):
            if b > at:
                done += "" if a < at else text[at:a] + f"[{kind.upper()}]"
                at = b
        out.append(done + text[at:])
    return out


def test_against_a_plain_version(spark, tmp_path):
    rows = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCHMARK, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [r for r, (_, keep) in zip(rows, plain_verdicts([(r[2], r[1]) for r in rows])) if keep]
    prints = [plain_print(r[1]) for r in kept]
    first = {}
    for root, r in zip(roots_of(prints, 3), kept):
        first.setdefault(root, r)  # rows come by id
    kept = list(first.values())
    clean = []
    for r in kept:
        n, hit, _ = plain_search(BENCHMARK, r[1], 13)
        if not hit or 20 * len(hit) < n:
            clean.append(r)
    masked = plain_mask([r[1] for r in clean])
    tokenizer = library()
    expected = []
    for r, text in zip(clean, masked):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((r[0], r[2], r[3], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.lang, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected)
    ids = {r[0] for r in clean}
    assert len(ids) < len(kept) < len(rows) and any("[SECRET]" in t for t in masked) and sum("[EMAIL]" in t for t in masked) > 16
