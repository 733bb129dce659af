"""From raw documents to token ids: five stages, each an operator of ``likeness.llm``.

Every stage works on all that the one before kept, and its decisions take
effect: rejected documents and all but one of each group of near copies go,
contaminated documents go, personal data is masked, and what stays is encoded.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm import bpe, decontaminate, pii, quality, simhash
from likeness.plans.staging import leased, stage

# Texts of this pipeline are long: fewer of them than Spark's default go to a
# Python worker at a time, so that two workers and a heap fit a small executor.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_TEXTS = 1_000

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows in a batch while a stage runs, unless the session has fewer already."""
    before = spark.conf.get(ARROW_ROWS)
    if not 0 < int(before) <= BATCH_TEXTS:
        spark.conf.set(ARROW_ROWS, str(BATCH_TEXTS))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def pipeline_stage(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run a stage's work and write its result, which is what the caller gets to read.

    Settings hold for the work alone, and what it staged on the way goes with
    the result.
    """

    @leased
    @functools.wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return stage(step(spark, docs, sf_dir), step.__name__)

    return run_stage


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns an operator uses, and all others in one, where no name can clash."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select(*used, "text", F.struct(*others).alias("_document"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col(f"_document.{c}").alias(c) for c in columns))


@pipeline_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble their language.

    Null and empty texts fail the base rules. A null language is one of its
    own; repeated rows are judged alike and stay; words of equal counts enter a
    reference by their spelling. An empty table stays empty. Columns of any
    name stay, also those called as the operator's.
    """
    judged = quality.judge(packed(docs, "lang"))
    return unpacked(judged.filter("kept"), docs.columns)


@pipeline_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies.

    Texts without words, null ones too, are copies of each other. Of rows that
    share the smallest id, one stays by a fixed order of texts and columns; a
    group without ids keeps one row. An empty table stays empty; columns of any
    name stay.
    """
    return unpacked(simhash.one_of_each(packed(docs, "doc_id")), docs.columns)


@pipeline_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under one word in twenty lies in a benchmark's windows.

    Texts without words, null ones too, stay, as does every row that is
    repeated. An empty table stays empty, an empty benchmark takes nothing;
    columns of any name stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_items(packed(docs), benchmark)
    hit = decontaminate.hit_words()
    return unpacked(found.filter(~decontaminate.contaminated(hit, F.col("n_words"))), docs.columns)


@pipeline_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked by its kind; ``n_chars`` follows the text, a null text stays null.

    Empty texts stay as they are, and so does the number of rows, repeated ones
    included. Ties between kinds are settled by their names. An empty table
    stays empty; columns of any name stay.
    """
    masked = unpacked(pii.redact(pii.find(packed(docs))), docs.columns)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


@pipeline_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of ids and decoded text.

    Null and empty texts have no ids. Every row stays, repeated ones too; an
    empty table gives none. Of other columns ``doc_id``, ``lang`` and
    ``source`` stay, as nulls where the table has none of that name.
    """
    named = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("doc_id", "lang", "source")]
    encoded = bpe.encode(docs.select(*named, "text"), TOKENIZER)
    return bpe.decode(encoded.drop("text"), TOKENIZER).select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

# Fingerprints, grown patterns and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = step(spark, docs, sf_dir)
    return docs
