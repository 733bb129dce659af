import random
import re

from likeness.llm import decontaminate
from likeness.llm.wu_manber import Searcher

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(items, text, window):
    words, hit, ids = plain_words(text), set(), set()
    for item_id, item in items:
        found = plain_words(item)
        size = min(window, len(found))
        wins = {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()
        for i in range(len(words) - size + 1) if wins else ():
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                ids.add(item_id)
    return len(words), sorted(hit), sorted(i for i in ids if i is not None)


def test_search_against_brute_force():
    rnd = random.Random(1)
    pool = ["a", "b", "ab", "é", "Aé", "x1", "longerword", "another", "9"]
    for _ in range(150):
        text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(pool) for _ in range(n))
        items = [(str(i), text(rnd.randrange(0, 9))) for i in range(4)]
        searcher = Searcher(items, 4)
        for _ in range(5):
            doc = text(rnd.randrange(0, 60))
            n, spans, ids = searcher.search(doc)
            hit = [i for a, b in spans for i in range(a, b)]
            assert (n, hit, ids) == plain_search(items, doc, 4)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
DOCS = [
    (1, "x " + ITEM + " y", 5),
    (1, "x " + ITEM + " y", 5),
    (2, None, 5),
    (3, "", 5),
    (None, "short item here", 5),
    (4, "w " * 100_000 + "short item", 5),
    (5, "nothing", None),
]
ITEMS = [(10, ITEM), (9, "short item"), (8, None), (7, ""), (None, "nothing"), (11, ITEM.upper())]


def found(spark, docs=DOCS, items=ITEMS, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return decontaminate.find_items(df, bench, **options)


def test_edges_and_slices(spark):
    one = found(spark)
    assert one.columns == ["doc_id", "text", "n_words", "hit_spans", "item_ids"]
    rows = sorted(map(str, decontaminate.report(one).collect()))
    by_id = {r.doc_id: r for r in decontaminate.report(one).collect()}
    assert len(rows) == len(DOCS)
    assert (by_id[1].n_words, by_id[1].n_hit, by_id[1].n_items, by_id[1].contaminated) == (16, 14, 2, True)
    assert (by_id[2].n_words, by_id[2].contaminated) == (0, False)
    assert (by_id[4].n_hit, by_id[4].contaminated) == (2, False)
    assert (by_id[5].n_hit, by_id[5].n_items, by_id[5].contaminated) == (1, 0, True)
    sliced = decontaminate.report(found(spark, slice_bytes=1))
    assert sorted(map(str, sliced.collect())) == rows


def test_empty_tables(spark):
    assert found(spark, docs=[]).count() == 0
    none = found(spark, items=[]).filter("size(hit_spans) > 0")
    assert none.count() == 0
