"""One pass over fixed-point vectors, inside Spark tasks.

Vectors are rows of little-endian 64-bit integers. A pass gives the sums of one
task; sums of all tasks are added up behind it.

Pickled by value: executors need numpy and pyarrow only.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = "<i8"


def fixed_batches(batches, scale: int, shift: int, kind: pa.DataType):
    """``(vec_id, vector)`` of finite numbers to ``(vec_id, x)``, x = floor(scale * c) + shift."""
    schema = pa.schema([("vec_id", kind), ("x", pa.binary())])
    for batch in batches:
        vectors = batch.column(1)
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = np.floor(values * scale).astype(WORD) + shift
        ends = np.cumsum([0, *np.diff(vectors.offsets.to_numpy())]).astype(np.int32) * x.itemsize
        packed = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(x.astype(WORD))])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), packed], schema=schema)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a binary column, maybe a slice of one."""
    _, offsets, data = column.buffers()
    begin = int(np.frombuffer(offsets, np.int32, 1, column.offset * 4)[0])
    return np.frombuffer(data, WORD, len(column) * dims, begin).reshape(-1, dims)


class Centre:
    """The mean, as a whole number and a fraction, so that nothing is lost on the way."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part


def moments(x: np.ndarray) -> list[np.ndarray]:
    return [np.array([len(x)]), x.sum(axis=0), (x * x).sum(axis=0)]


class Left:
    """Left vectors, had back from the rows: X V = U R, so U = X V R^-1."""

    def __init__(self, centre: Centre, right: np.ndarray, coefficients: np.ndarray):
        self.centre, self.right = centre, right
        self.inverse = np.linalg.inv(coefficients) if len(coefficients) else coefficients

    def __call__(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.right @ self.inverse


def forward(x: np.ndarray, left: Left, v: np.ndarray) -> list[np.ndarray]:
    """Of p = Xv: its products with all left vectors, and its square."""
    centred = left.centre(x)
    p = centred @ v
    return [left(centred).T @ p, np.array([p @ p])]


def backward(x: np.ndarray, left: Left, v: np.ndarray, gone: np.ndarray) -> list[np.ndarray]:
    """Of q = Xv - U gone: its products with all left vectors, its square, and X'q."""
    centred = left.centre(x)
    u = left(centred)
    q = centred @ v - u @ gone
    return [u.T @ q, np.array([q @ q]), centred.T @ q]


def spread(x: np.ndarray, centre: Centre, directions: np.ndarray) -> list[np.ndarray]:
    """Sums and products of whitened rows."""
    white = centre(x) @ directions
    return [white.sum(axis=0), (white.T @ white).ravel()]


SUMS = pa.schema([("sums", pa.binary())])


def _row(total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], schema=SUMS)


def pass_batches(batches, dims: int, work):
    """The sums of a task: those of ``work`` of each batch, end to end."""
    total = None
    for batch in batches:
        if batch.num_rows:
            found = np.concatenate(work(matrix(batch.column(0), dims)))
            total = found if total is None else total + found
    yield _row(total)


def sum_batches(batches, kind: str):
    total = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            found = np.frombuffer(raw, kind)
            total = found.copy() if total is None else total + found
    yield _row(total)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums over the dimensions of (n*x - S)^2."""
    off = n * x - np.array(sums, np.int64)
    most = int(np.abs(off).max()) if off.size else 0
    if most * most * max(1, off.shape[1]) < 1 << 63:
        return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([str(sum(v * v for v in row)) for row in off.tolist()]).cast(pa.decimal128(38, 0))


def white_batches(batches, dims: int, n: int, sums: list[int], centre: Centre, directions: np.ndarray, kind: pa.DataType):
    """One row for each vector and component."""
    schema = pa.schema(
        [("vec_id", kind), ("component", pa.int32()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64())]
    )
    k = directions.shape[1]
    for batch in batches:
        x = matrix(batch.column(1), dims)
        each = np.repeat(np.arange(len(x)), k)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(kind).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                deviations(x, n, sums).take(pa.array(each)),
                pa.array((centre(x) @ directions).ravel()),
            ],
            schema=schema,
        )
