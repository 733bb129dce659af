"""MinHash vectors and signatures; only the prime family shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.hashing import BLOCK, PART, MultiplyShiftFamily, PrimeFamily, draw_indices
from likeness.params import MinHashParams

FAMILIES = {"multiply_shift": MultiplyShiftFamily, "prime": PrimeFamily}


def with_minhash(
    sentence_rows: DataFrame, params: MinHashParams, family: str = "multiply_shift"
) -> DataFrame:
    """Add ``mh``: one minimum per hash function over the row's shingles; null without any."""
    functions = FAMILIES[family](params)
    if family == "prime":
        return _grouped_minhash(sentence_rows, functions)
    return sentence_rows.withColumn("mh", functions.minhash(F.col("sentence")))


def _grouped_minhash(sentence_rows: DataFrame, functions: PrimeFamily) -> DataFrame:
    """The values of ``functions.minhash``, by an explode and a grouping that the JVM compiles.

    Tasks add up the windows of their rows before the shuffle, which moves each
    row once. A number keeps equal rows apart.
    """
    columns = sentence_rows.columns
    keys = [*columns, "_row"]
    blocks = (
        sentence_rows.withColumn("_row", F.monotonically_increasing_id())
        .select(*keys, F.explode_outer(F.expr(functions.starts("sentence", PART))).alias("_at"))
        .select(*keys, F.expr(functions.cut("sentence", "_at", PART)).alias("_part"))
        .select(*keys, "_part", F.explode_outer(F.expr(functions.starts("_part", BLOCK))).alias("_at"))
        .select(*keys, F.expr(functions.cut("_part", "_at", BLOCK)).alias("_block"))
    )
    names = [f"_base{i}" for i in range(BLOCK)]
    hashed = blocks.select(*keys, *[F.expr(x).alias(name) for name, x in zip(names, functions.bases("_block"))])
    minima = F.when(F.length("sentence") >= functions.shingle_len, F.col("mh"))
    return hashed.groupBy(*keys).agg(F.expr(functions.minima(names)).alias("mh")).select(*columns, minima.alias("mh"))


def minhash_values(vectors: DataFrame) -> DataFrame:
    """Long form of ``mh``: ``(doc_id, ord, fn, value)``."""
    return vectors.select("doc_id", "ord", F.posexplode("mh").alias("fn", "value"))


def single_function(vectors: DataFrame, fn: int) -> DataFrame:
    """Values of one hash function of the family."""
    return vectors.select("doc_id", "ord", F.element_at("mh", fn + 1).alias("value"))


def argmin_shingles(sentence_rows: DataFrame, params: MinHashParams) -> DataFrame:
    """The first shingle that attains each function's minimum."""
    positions = MultiplyShiftFamily(params).argmin(F.col("sentence"))
    # Cut out before the explode, which would copy the sentence for each function.
    shingles = F.transform("at", lambda at: F.substring(F.col("sentence"), at, F.lit(params.shingle_len)))
    return sentence_rows.withColumn("at", positions).select(
        "doc_id", "ord", F.posexplode(shingles).alias("fn", "shingle")
    )


def signatures(vectors: DataFrame, params: MinHashParams) -> DataFrame:
    """One row ``(draw, sig, doc_id, ord)`` per sentence and draw.

    The draw number is part of the bucket key: two draws that happen to use the
    same functions never bring a sentence together with itself. The index lists
    are exploded and the values picked afterwards: one array of all signatures
    would be a single method too long for the JVM to compile, which costs more
    than ten times as much. A ``row`` number, if there is one, stays.
    """
    ids = [c for c in ("doc_id", "ord", "row") if c in vectors.columns]
    draws = F.array(*[F.array(*map(F.lit, indices)) for indices in draw_indices(params)])
    picked = [F.get("mh", F.get("indices", F.lit(i))) for i in range(params.sig_len)]
    return vectors.select(
        *ids, "mh", F.posexplode(draws).alias("draw", "indices")
    ).select("draw", F.array(*picked).alias("sig"), *ids)


def signature_of(params: MinHashParams, mh: Column, draw: Column) -> Column:
    """The signature that ``signatures`` gives a row in one draw."""
    draws = F.array(*[F.array(*map(F.lit, indices)) for indices in draw_indices(params)])
    return F.array(*[F.get(mh, F.get(F.get(draws, draw), F.lit(i))) for i in range(params.sig_len)])


def signature_text(sig) -> F.Column:
    """``[v1, v2, ...]``"""
    return F.concat(F.lit("["), F.array_join(sig.cast("array<string>"), ", "), F.lit("]"))
