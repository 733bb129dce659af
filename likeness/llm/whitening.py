"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from likeness.llm import whitening_kernel as kernel
from likeness.plans.staging import stage

SCALE, SHIFT = 1_024, 100_000
COMPONENTS = 8
# Sums of tasks that go to the driver; those of more tasks are added up before.
MOST_SUMS = 2_048
# A direction this much weaker than the strongest has no length to divide by.
NEGLIGIBLE = 1e-11
SEED = 11


@dataclass
class Vectors:
    """Fixed-point vectors in the shared folder, with their exact moments."""

    rows: DataFrame
    dims: int
    n: int
    sums: list[int]
    squares: list[int]

    def total(self, work, dtype=np.float64) -> np.ndarray:
        """The sums of ``work`` over all rows: one row from each task, never the vectors."""
        parts = self.rows.select("x").mapInArrow(partial(kernel.pass_batches, dims=self.dims, work=work), "sums binary")
        tasks = self.rows.rdd.getNumPartitions()
        if tasks > MOST_SUMS:
            add = partial(kernel.sum_batches, kind=np.dtype(dtype).str)
            parts = parts.repartition(-(-tasks // MOST_SUMS)).mapInArrow(add, "sums binary")
        found = [np.frombuffer(r["sums"], dtype) for r in parts.collect()]
        if dtype is np.int64:  # sums of tasks fit 64 bits, theirs need not
            return sum(x.astype(object) for x in found) if found else np.zeros(0, object)
        return np.sum(found, axis=0)


def prepare(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Vectors:
    """Vectors of finite numbers as whole numbers ``floor(scale * c) + shift``.

    Null vectors and those with a null or non-finite entry are dropped, and
    those that have not the most frequent number of dimensions (of two as
    frequent the larger). Repeated rows count each time; other columns are left
    aside.
    """
    own = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = own.filter(F.col("vector").isNotNull() & finite)
    sizes = whole.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    dims = most["d"] if most else 0
    kind = own.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("x", T.BinaryType())])
    work = partial(kernel.fixed_batches, scale=scale, shift=shift, kind=to_arrow_type(kind))
    rows = stage(whole.filter(F.size("vector") == dims).mapInArrow(work, schema), "vectors")
    vectors = Vectors(rows, dims, 0, [], [])
    if dims:
        found = [int(v) for v in vectors.total(kernel.moments, np.int64)]
        vectors.n, vectors.sums, vectors.squares = found[0], found[1 : dims + 1], found[dims + 1 :]
    return vectors


def _fresh(rng, right: list[np.ndarray], dims: int) -> np.ndarray:
    """A unit vector at right angles to all so far."""
    return _cleared(rng.normal(size=dims), right)[0]


def _cleared(w: np.ndarray, right: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """``w`` without its parts along ``right``, of length one; and its length before."""
    for _ in range(2):
        for v in right:
            w = w - (v @ w) * v
    length = float(np.linalg.norm(w))
    return (w / length if length else w), length


def bidiagonal(vectors: Vectors, centre: kernel.Centre, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """``(V, B)``: orthonormal right vectors, and the upper bidiagonal U'XV.

    Alternates u = Xv and v = X'u, two passes over the rows for each of as many
    steps as there are dimensions. Both sides are reorthogonalised against all
    vectors before, twice. The left vectors are as long as the table and are
    never written: every pass has them back from the rows, V and the
    coefficients of the steps so far, so a lost executor repeats its share of
    one pass. Where a chain ends early, for want of rank or because values
    repeat, a fresh one begins at right angles to it.
    """
    dims, rng = vectors.dims, np.random.default_rng(seed)
    right: list[np.ndarray] = []
    alphas, betas = np.zeros(dims), np.zeros(dims)
    live: list[int] = []  # steps that have a left vector
    R = np.zeros((dims, dims))
    back: dict[int, np.ndarray] = {}  # X'u of each left vector
    scale = float(np.sqrt(sum(vectors.squares)))  # rounding of centred rows is relative to this
    strongest = 0.0
    v = _fresh(rng, right, dims)
    for k in range(dims):
        left = kernel.Left(centre, np.array([right[j] for j in live]).T.reshape(dims, -1), R[np.ix_(live, live)])
        found = vectors.total(partial(kernel.forward, left=left, v=v))
        gone = found[: len(live)]
        found = vectors.total(partial(kernel.backward, left=left, v=v, gone=gone))
        again, square, w = found[: len(live)], found[len(live)], found[len(live) + 1 :]
        alpha = float(np.sqrt(max(0.0, square - again @ again)))
        strongest = max(strongest, alpha)
        right.append(v)
        if alpha > max(NEGLIGIBLE * strongest, 1e-15 * scale):
            back[k] = (w - sum((a * back[j] for a, j in zip(again, live)), np.zeros(dims))) / alpha
            R[live, k] = gone + again
            R[k, k] = alphas[k] = alpha
            live.append(k)
            v, length = _cleared(back[k] - alpha * v, right)
        else:
            v, length = v, 0.0
        if k + 1 < dims:
            if length > NEGLIGIBLE * strongest:
                betas[k + 1] = length
            else:
                v = _fresh(rng, right, dims)
    return np.array(right).T, np.diag(alphas) + np.diag(betas[1:], 1)


@dataclass
class Whitening:
    vectors: Vectors
    centre: kernel.Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float]
    identity_error: float

    @property
    def directions(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def fit(vectors: Vectors, components: int = COMPONENTS, seed: int = SEED) -> Whitening | None:
    """Unit eigenvectors of the covariance, by falling eigenvalue; None if nothing varies.

    The larger entries of a component come out positive. Directions without
    variance have no component, so there may be fewer.
    """
    n = vectors.n
    trace = sum(Fraction(q, n) - Fraction(s, n) ** 2 for q, s in zip(vectors.squares, vectors.sums)) if n else 0
    if not trace:
        return None
    centre = kernel.Centre(n, vectors.sums)
    right, small = bidiagonal(vectors, centre, seed)
    _, values, turned = np.linalg.svd(small)
    chosen = [i for i in range(min(components, len(values))) if values[i] > NEGLIGIBLE * values[0]]
    found = (right @ turned.T)[:, chosen]
    found /= np.linalg.norm(found, axis=0)
    found *= np.sign(found[np.abs(found).argmax(axis=0), range(len(chosen))])
    eigenvalues = values[chosen] ** 2 / n
    sums = vectors.total(partial(kernel.spread, centre=centre, directions=found / np.sqrt(eigenvalues)))
    k = len(chosen)
    mean = sums[:k] / n
    covariance = sums[k:].reshape(k, k) / n - np.outer(mean, mean)
    return Whitening(
        vectors,
        centre,
        found,
        eigenvalues,
        [float(e / float(trace)) for e in eigenvalues],
        float(np.abs(covariance - np.eye(k)).max()),
    )


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, seed: int = SEED) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    One row for each vector that ``prepare`` keeps and each component, numbered
    from 1. ``deviation`` is an exact decimal. No vectors, one vector, or
    vectors that are all equal give no rows; null and repeated ids keep theirs.
    """
    vectors = prepare(embeddings, vec_id, vector)
    found = fit(vectors, components, seed)
    kind = vectors.rows.schema["vec_id"].dataType
    schema = T.StructType(
        [
            T.StructField("vec_id", kind),
            T.StructField("component", T.IntegerType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.DoubleType()),
        ]
    )
    if found is None:
        rows = vectors.rows.sparkSession.createDataFrame([], schema)
    else:
        work = partial(
            kernel.white_batches,
            dims=vectors.dims,
            n=vectors.n,
            sums=vectors.sums,
            centre=found.centre,
            directions=found.directions,
            kind=to_arrow_type(kind),
        )
        rows = vectors.rows.mapInArrow(work, schema)
    shares = F.array(*map(F.lit, found.explained if found else [0.0]))
    return rows.select(
        "vec_id",
        "component",
        F.lit(vectors.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("component") - 1].alias("explained"),
        F.lit(found.identity_error if found else 0.0).alias("identity_error"),
    )


def digests(whitened: DataFrame) -> DataFrame:
    """The digest form: deviations as 64-bit numbers, or an error where they are larger."""
    return whitened.withColumn("deviation", F.col("deviation").cast("bigint"))
