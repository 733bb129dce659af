import hashlib
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import plan_text, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from likeness.functions import kernels
from likeness.functions.hashing import PRIME, MultiplyShiftFamily, PrimeFamily, draw_indices
from likeness.operators.minhash import (
    argmin_shingles,
    minhash_values,
    signature_text,
    signatures,
    single_function,
    with_minhash,
)
from likeness.params import MinHashParams

SCHEMA = "doc_id bigint, ord int, sentence string"


def brute_hashes(family, text):
    """Hash of every shingle by every function, in plain integers."""
    k = family.shingle_len
    table = []
    for i in range(len(text) - k + 1):
        shingle = text[i : i + k]
        words = [
            sum(ord(c) << (21 * j) for j, c in enumerate(shingle[w : w + 3]))
            for w in range(0, k, 3)
        ]
        table.append(
            [
                ((sum(v * int(a) for v, a in zip(words, row)) + int(b)) % 2**64)
                >> (64 - family.bits)
                for row, b in zip(family.a, family.b)
            ]
        )
    return np.array(table, dtype=object)


def batch(family, texts, kernel=kernels.minhash_batch):
    return kernel(
        pa.array(texts, pa.string()), family.shingle_len, family.a, family.b, family.bits
    ).to_pylist()


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8),
    st.integers(1, 8),
    st.sampled_from([8, 31, 60, 63]),
)
def test_kernels_match_plain_integers(texts, k, bits):
    family = MultiplyShiftFamily(MinHashParams(num_hashes=4, shingle_len=k, hash_bits=bits))
    minima, places = batch(family, texts), batch(family, texts, kernels.argmin_batch)
    for text, found, at in zip(texts, minima, places):
        table = brute_hashes(family, text or "")
        if len(table) == 0:
            assert found is None and at is None
            continue
        assert found == table.min(axis=0).tolist()
        assert at == [int(np.argmax(col == col.min())) + 1 for col in table.T]


def test_blocks_do_not_change_results(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdé😀 ", k=rng.randint(0, 90))) for _ in range(200)]
    family = MultiplyShiftFamily(MinHashParams())
    whole = batch(family, texts)
    for size in (1, 50, 333):
        monkeypatch.setattr(kernels, "BLOCK_CHARS", size)
        assert batch(family, texts) == whole


def test_prime_family(spark):
    params = MinHashParams(num_hashes=5, shingle_len=4)
    family = PrimeFamily(params)
    text = "Déjà vu, encore."
    df = spark.createDataFrame([(1, 0, text), (1, 1, "abc")], SCHEMA)
    found = {r["ord"]: r["mh"] for r in with_minhash(df, params, "prime").collect()}
    bases = [
        int(hashlib.md5(text[i : i + 4].encode()).hexdigest()[:8], 16) % PRIME
        for i in range(len(text) - 3)
    ]
    assert found[0] == [min((x * a + b) % PRIME for x in bases) for a, b in zip(family.a, family.b)]
    assert found[1] is None


def test_prime_family_on_tables(spark):
    """Compiled plans, and on any number of windows the values of the plain integers; equal rows stay two."""
    params = MinHashParams(num_hashes=3, shingle_len=4)
    family = PrimeFamily(params)
    texts = [None, "", "abc", *("".join(random.Random(n).choices("ab é😀", k=n)) for n in (*range(4, 13), 66, 67, 68, 131, 132, 200))]
    data = [(None if i % 5 == 4 else i // 2, 0, t) for i, t in enumerate(texts)] + [(1, 0, texts[-1])] * 2
    found = with_minhash(spark.createDataFrame(data, SCHEMA), params, "prime")
    assert found.columns == ["doc_id", "ord", "sentence", "mh"]
    plan = plan_text(found)
    assert "lambda" not in plan and "Python" not in plan and "Arrow" not in plan

    def minima(text):
        windows = [text[i : i + 4] for i in range(len(text or "") - 3)]
        bases = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % PRIME for w in windows]
        return str([min((x * a + b) % PRIME for x in bases) for a, b in zip(family.a, family.b)]) if bases else None

    as_text = found.withColumn("mh", signature_text(F.col("mh")))
    assert rows(as_text) == Counter((*row, minima(row[2])) for row in data)


def test_values_single_function_and_argmin_agree(spark, documents):
    from likeness.operators.sentences import candidates

    params = MinHashParams(num_hashes=6)
    found = candidates(documents.limit(20), params).cache()
    vectors = with_minhash(found, params)
    values = minhash_values(vectors)
    assert rows(single_function(vectors, 2)) == rows(values.filter("fn = 2").drop("fn"))
    family = MultiplyShiftFamily(params)
    shingles = argmin_shingles(found, params).join(values, ["doc_id", "ord", "fn"])
    for row in shingles.limit(50).collect():
        assert brute_hashes(family, row["shingle"])[0][row["fn"]] == row["value"]


def test_signature_draws(spark):
    params = MinHashParams(num_hashes=7, draws=3, sig_len=4)
    drawn = draw_indices(params)
    assert [len(d) for d in drawn] == [4, 4, 4] and all(0 <= i < 7 for d in drawn for i in d)
    assert drawn == draw_indices(params) != draw_indices(MinHashParams(7, 60, 4, 3, seed=1))
    values = [10, 11, 12, 13, 14, 15, 16]
    df = spark.createDataFrame([(1, 2, values)], "doc_id bigint, ord int, mh array<bigint>")
    found = signatures(df, params)
    assert {r["draw"]: r["sig"] for r in found.collect()} == {
        j: [values[i] for i in d] for j, d in enumerate(drawn)
    }
    text = found.filter("draw = 0").select(signature_text(F.col("sig"))).first()[0]
    assert text == str([values[i] for i in drawn[0]])


def test_agreement_estimates_jaccard():
    params = MinHashParams(num_hashes=400, shingle_len=5)
    family = MultiplyShiftFamily(params)
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghijklmnop ", k=300))
    other = base[:220] + "".join(rng.choices("abcdefghijklmnop ", k=80))
    a, b = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (base, other))
    x, y = batch(family, [base, other])
    assert abs(np.mean(np.array(x) == np.array(y)) - len(a & b) / len(a | b)) < 0.1


def test_udf_code_needs_no_package_on_executors(tmp_path):
    family = MultiplyShiftFamily(MinHashParams(num_hashes=3, shingle_len=4))
    args = (family.shingle_len, family.a, family.b, family.bits)
    shipped = cloudpickle.dumps(kernels.bind(kernels.minhash_batch, *args))
    (tmp_path / "f.pkl").write_bytes(shipped)
    code = "import pickle, pyarrow as pa; print(pickle.load(open('f.pkl', 'rb'))(pa.array(['abcdef'])))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert str(batch(family, ["abcdef"])[0][0]) in run.stdout


def test_argmin_shingles_are_cut_out_before_the_explode(spark):
    df = spark.createDataFrame([(1, 0, "abcdefghijklmnop")], "doc_id bigint, ord int, sentence string")
    copied = re.findall(r"Generate posexplode.*\), \[([^\]]*)\], false", plan_text(argmin_shingles(df, MinHashParams())))
    assert copied and all("sentence" not in columns for columns in copied)


def test_argmin_in_gaps_and_ties():
    """No window over the end of a text counts, and the first of equal hashes does."""
    a, b = np.ones((3, 1), np.uint64), np.zeros(3, np.uint64)
    found = kernels.argmin_batch(pa.array(["cba", None, "aab", "", "zzz", "b"]), 1, a, b, 63).to_pylist()
    assert found == [[3] * 3, None, [1] * 3, None, [1] * 3, [1] * 3]
