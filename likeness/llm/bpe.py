"""BPE encoding by backtracking over longest matches, and decoding by offsets."""

from __future__ import annotations

from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.llm import bpe_kernel as kernel


def tables(spark: SparkSession, path: str):
    """Broadcast the tables of a tokenizer file; a vocabulary is a few MB."""
    return spark.sparkContext.broadcast(kernel.sealed(kernel.Tables(Path(path).read_text())))


def _with_column(rows: DataFrame, name: str, kind: T.DataType, work) -> DataFrame:
    kept = rows.drop(name)
    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(name, kind)]))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``n_tokens`` to every row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers: those of the tokenizer
    file at ``path`` without added special tokens; the texts of special tokens
    inside a text become their ids. Null and empty texts have none. Rows stay
    apart however often they repeat; other columns stay, but for the two added.
    """
    shared = tables(docs.sparkSession, path)
    work = partial(kernel.encode_batches, shared=shared, text=text)
    encoded = _with_column(docs.drop("n_tokens"), "ids", T.BinaryType(), work)
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the texts of the tokens joined by a space.

    That is what a tokenizer file without a decoder asks for; special tokens
    are shown. No ids, or null, give an empty text.
    """
    work = partial(kernel.decode_batches, shared=tables(encoded.sparkSession, path), ids=ids)
    return _with_column(encoded, "decoded", T.StringType(), work)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """The digest form of ``encode`` and ``decode``: one row per document."""
    rows = decode(encoded.select("doc_id", "n_tokens", "ids"), path)
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
