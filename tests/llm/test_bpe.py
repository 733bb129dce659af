import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from likeness.llm import bpe
from likeness.llm.bpe_kernel import Codec, Tables

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(n):
    rnd = random.Random(2)
    pieces = ["<|endoftext|>", "<|", "the", "İΣ", "\x1c", "\x85", "\xa0", "é", "é", " ", "ing", "don't", "ÿ", "文", "😀"]
    for _ in range(n):
        size = rnd.randrange(0, 50)
        kind = rnd.random()
        if kind < 0.4:
            yield "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz'ABC 0123 ") for _ in range(size))
        elif kind < 0.8:
            yield "".join(rnd.choice(pieces) for _ in range(size))
        else:
            yield "".join(chr(rnd.randrange(1, 0x500)) for _ in range(size))


def test_same_as_the_library():
    theirs = Tokenizer.from_file(PATH)
    with open(PATH) as f:
        ours = Codec(Tables(f.read()))
    for text in texts(4000):
        ids = theirs.encode(text, add_special_tokens=False).ids
        mine = ours.ids(text)
        assert mine == np.array(ids, "<u4").tobytes(), repr(text)
        assert ours.text(mine).decode() == theirs.decode(ids, skip_special_tokens=False)


def test_edges(spark):
    long = "word's " * 50_000
    rows = [(1, "the end", 0), (1, "the end", 0), (2, None, 0), (3, "", 0), (None, long, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(got) == 5
    counts = {r.text: r.n_tokens for r in got}
    assert counts == {"the end": 2, None: 0, "": 0, long: 100_000}
    assert {r.decoded for r in got if not r.text} == {""}
    assert bpe.digests(bpe.encode(df.limit(0), PATH), PATH).count() == 0
