"""Packing token sequences of one size from documents, by the histogram of lengths."""

from __future__ import annotations

from functools import partial, reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from likeness.llm import packing_kernel as kernel
from likeness.llm.ranks import ranked
from likeness.plans.staging import stage

SIZE = 4_096
# Stands behind the ids of each document.
LAST_ID = 2
# Rows of the plan, 40 bytes each, that go to all tasks at a time.
PLAN_ROWS = 200_000


def cut(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, last_id: int = LAST_ID
) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids)``: pieces of at most ``size`` ids.

    ``ids`` are those of the tokenizer file at ``path`` without added special
    tokens, little-endian and unsigned 32 bits wide, with ``last_id`` behind
    each document. A document of more than ``size`` ids gives full pieces and
    one for the rest. Null and empty texts have the last id alone. Every row is
    a document of its own, also where ids are null or repeat. The tokenizer has
    to drop white space and to match nothing across it.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(path).read_text())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string"))
    kind = rows.schema["doc_id"].dataType
    fields = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("ids", T.BinaryType())]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(*f) for f in fields)])
    work = partial(
        kernel.piece_batches,
        shared=_Shared(shared),
        last_id=last_id,
        size=size,
        kind=to_arrow_type(kind),
    )
    return rows.mapInArrow(work, schema)


class _Shared:
    """A broadcast with the number by which a worker knows what it has built from it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value


def place(pieces: DataFrame, size: int = SIZE, plan_rows: int = PLAN_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``size``.

    Shortest-pack-first over the histogram of lengths, which has ``size``
    entries whatever the table: lengths are placed longest first, each into the
    sequences with the most room. The plan says how many pieces of a length go
    where; pieces find their place in it by their rank within the length. Ranks
    come from a range sort, so that a length of a third of all rows is spread;
    rows that are equal in all columns take theirs in any order. The plan goes
    to the tasks in slices of ``plan_rows``. No rows give none.
    """
    order = [c for c, t in pieces.drop("length").dtypes if not t.startswith(("map", "binary"))]
    rows = stage(ranked(pieces, ["length"], order, "_rank"), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = kernel.slices(kernel.plan(histogram, size), plan_rows)
    placed = [_placed(rows if len(parts) == 1 else _of_lengths(rows, part), part) for part in parts]
    return reduce(DataFrame.unionByName, placed)


def _of_lengths(rows: DataFrame, table: np.ndarray) -> DataFrame:
    return rows.filter(F.col("length").between(int(table[0, 0]), int(table[-1, 0])))


def _placed(rows: DataFrame, table: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def batch(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        return kernel.place_batch(lengths, ranks, shared.value)

    found = F.arrow_udf(batch, "struct<sequence_id:bigint,offset:bigint>")
    return (
        rows.withColumn("_place", found(F.col("length"), F.col("_rank")))
        .withColumns({"sequence_id": F.col("_place.sequence_id"), "offset": F.col("_place.offset")})
        .drop("_place", "_rank")
    )


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces of ``docs`` with their ids, each with its sequence and its place there."""
    return place(cut(docs, path, doc_id, text, size), size)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, lengths)``: the ids of each sequence, and how long its pieces are.

    A sequence has ``size`` pieces at most, so a group stays small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts.ids", F.lit(b""), lambda all_ids, ids: F.concat(all_ids, ids)).alias("ids"),
            F.col("parts.length").alias("lengths"),
        )
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The digest form: one row per piece, placed without carrying its ids along."""
    pieces = cut(docs, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"
    )
    return place(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
