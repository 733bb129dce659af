"""Documents to sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions.text import sentence_array, shingle_array, shingle_count
from likeness.params import MinHashParams


def sentences(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, ord, sentence)``.

    ``ord`` counts every sentence of the document from 0, also those that a
    later length filter drops.
    """
    return documents.select("doc_id", F.posexplode(sentence_array(F.col("text")))).toDF(
        "doc_id", "ord", "sentence"
    )


def length_filter(sentence_rows: DataFrame, params: MinHashParams) -> DataFrame:
    """Sentences whose shingle count lies strictly between the bounds."""
    n = shingle_count(F.col("sentence"), params.shingle_len)
    return sentence_rows.filter((n > params.min_shingles) & (n < params.max_shingles))


def candidates(documents: DataFrame, params: MinHashParams) -> DataFrame:
    return length_filter(sentences(documents), params)


def shingle_counts(sentence_rows: DataFrame, params: MinHashParams) -> DataFrame:
    """Shingles and distinct shingles of every sentence."""
    shingles = shingle_array(F.col("sentence"), params.shingle_len)
    return sentence_rows.select(
        "doc_id",
        "ord",
        shingle_count(F.col("sentence"), params.shingle_len).alias("n_shingles"),
        F.size(F.array_distinct(shingles)).alias("n_distinct"),
    )
