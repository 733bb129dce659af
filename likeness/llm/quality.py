"""Quality rules: simple counts, and divergence from the language's usual text."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm import quality_kernel as kernel
from likeness.plans.staging import shuffle_partitions, shuffle_tasks, stage

# Words that make up a language's common-word histogram, beside all others.
COMMON = 50
MIN_WORDS = kernel.MIN_WORDS
# Words of a language that are counted in full for each that is wanted, twenty
# times as many where a task has left none out; words that a part of a task
# reports for each of those. Both grow until the wanted ones are proven.
CANDIDATES, WHOLE, REPORTED = 4, 20, 10
# Languages whose tables are broadcast, about 2 KB each; those of more are
# joined, each language in so many parts.
BROADCAST_LANGUAGES = 20_000
LANGUAGE_PARTS = 64
# Largest distances of a document of n words: base + slope / sqrt(n). Short
# texts stray further from any reference by chance alone, and as much further
# as their language's reference has few words itself.
CLASS_LIMIT = (0.17, 1.2)
WORD_LIMIT = (0.20, 2.4)
# From the characters of all languages together, letters of any kind alike.
POOLED_LIMIT = (0.40, 1.2)

# Profiles, of some 300 bytes, that a task sorts.
TASK_PROFILES = 500_000

_REPORT = "lang string, word string, n bigint, texts bigint"
_PROFILE = "key binary, lang string, n_words bigint, classes array<bigint>, at array<int>, n array<bigint>"
_TOTALS = "lang string, what int, at int, n bigint"
_JUDGED = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,class_distance:double,word_distance:double,pooled_distance:double>"
)


def _key(lang: str) -> Column:
    """A language's name as a key: null is a language of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))


def _with_language(docs: DataFrame, table: DataFrame, n: int, how: str) -> DataFrame:
    """Join a table of ``n`` languages to ``docs`` on ``_lang``, however many rows a language has."""
    if n <= BROADCAST_LANGUAGES:
        return docs.join(F.broadcast(table), "_lang", how)
    part = F.monotonically_increasing_id() % LANGUAGE_PARTS
    copies = table.withColumn("_part", F.explode(F.expr(f"sequence(0L, {LANGUAGE_PARTS - 1}L)")))
    return docs.withColumn("_part", part).join(copies, ["_lang", "_part"], how).drop("_part")


def _candidates(texts: DataFrame, common: int, grow: int) -> DataFrame:
    """``(_lang, words, beyond)``: frequent words, and what no other word's count exceeds."""
    report = stage(
        texts.mapInArrow(partial(kernel.report_batches, most=REPORTED * CANDIDATES * common * grow), _REPORT)
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")),
        "word_reports",
    )
    left_out = report.filter("word IS NULL").select("lang", F.col("n").alias("left_out"), F.col("texts").alias("n_texts"))
    wanted = CANDIDATES * common * grow
    limit = F.when(F.col("left_out") == 0, WHOLE * wanted).otherwise(wanted)
    by_use = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return (
        report.filter("word IS NOT NULL")
        .withColumn("at", F.row_number().over(by_use))
        .filter(F.col("at") <= WHOLE * wanted + 1)
        .join(left_out, "lang")
        .filter(F.col("at") <= limit + 1)
        .groupBy(F.col("lang").alias("_lang"))
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("at") <= limit, F.struct("at", "word")))).alias("words"),
            (F.first("left_out") + F.coalesce(F.max(F.when(F.col("at") > limit, F.col("n"))), F.lit(0))).alias("beyond"),
            F.first("n_texts").alias("texts"),
        )
        .select("_lang", F.array_join(F.col("words.word"), " ").alias("words"), "beyond", "texts")
    )


def _counted(texts: DataFrame, common: int, grow: int) -> DataFrame:
    """``(lang, n_words, words, counts, classes, proven)`` for the languages of ``texts(_lang, _text)``."""
    candidates = stage(_candidates(texts, common, grow), "candidates")
    n_languages, n_texts = candidates.agg(F.count("*"), F.coalesce(F.sum("texts"), F.lit(0))).first()
    rows = _with_language(texts, candidates.select("_lang", "words"), n_languages, "inner")
    profiles = rows.select("_lang", "_text", "words").mapInArrow(kernel.profile_batches, _PROFILE)
    spark = texts.sparkSession
    with shuffle_partitions(spark, shuffle_tasks(spark, n_texts, TASK_PROFILES)):
        totals = stage(
            profiles.dropDuplicates(["key"])
            .mapInArrow(kernel.total_batches, _TOTALS)
            .groupBy("lang", "what", "at")
            .agg(F.sum("n").alias("n")),
            "language_counts",
        )
    spelled = candidates.select("_lang", "beyond", F.posexplode(F.split("words", " ")).alias("at", "word"))
    by_use = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (
        totals.filter(F.col("what") == kernel.WORDS)
        .join(spelled, (F.col("lang") == F.col("_lang")) & (totals["at"] == spelled["at"]))
        .select("lang", "word", "n", "beyond", F.row_number().over(by_use).alias("place"))
        .filter(F.col("place") <= common)
        .groupBy("lang")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("top"),
            ((F.first("beyond") == 0) | (F.min("n") > F.first("beyond")) & (F.count("*") == common)).alias("proven"),
        )
    )
    classes = (
        totals.filter(F.col("what") == kernel.CLASS)
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("cls"))
    )
    return (
        totals.filter(F.col("what") == kernel.ALL)
        .select("lang", F.col("n").alias("n_words"))
        .join(classes, "lang")
        .join(top, "lang", "left")
        .select(
            "lang",
            "n_words",
            F.coalesce("top.word", F.array().cast("array<string>")).alias("words"),
            F.coalesce("top.n", F.array().cast("array<bigint>")).alias("counts"),
            F.col("cls.n").alias("classes"),
            F.coalesce("proven", F.lit(False)).alias("proven"),
        )
    )


def references(docs: DataFrame, lang: str = "lang", text: str = "text", common: int = COMMON) -> DataFrame:
    """``(_lang, n_words, words, counts, classes)`` from the different texts of ``docs``.

    Each text of a language counts once, however many copies it has, and only
    if it passes the base rules. ``_lang`` is ``=`` and the name, or empty for
    the null language, which is one of its own.

    The ``common`` most frequent words of each language, A-Z folded, with their
    counts (ties by word), and the character counts of each class. Tasks report
    their frequent words and the largest count left out; a second pass counts
    the leading ones exactly, in one narrow row for each text, of which one
    stays for each digest. Texts are not shuffled. Where the last word chosen
    does not beat all that was left out, the language is counted again with
    more words, until nothing is left out.
    """
    texts = docs.select(_key(lang).alias("_lang"), F.col(text).cast("string").alias("_text"))
    found, grow = None, 1
    while True:
        counted = stage(_counted(texts, common, grow), "references")
        proven = counted.filter("proven").drop("proven")
        found = proven if found is None else found.unionByName(proven)
        open_languages = counted.filter("NOT proven").select(F.col("lang").alias("_lang"))
        n = open_languages.count()
        if not n:
            return found.withColumnRenamed("lang", "_lang")
        texts = _with_language(texts, open_languages, n, "left_semi")
        grow *= 8


def _within(distance: str, limit: tuple[float, float], *sizes: Column) -> Column:
    slack = sum((limit[1] / F.sqrt(F.greatest(n, F.lit(1))) for n in sizes), F.lit(limit[0]))
    return F.coalesce(F.col(distance) <= slack, F.lit(True))


def judge(docs: DataFrame, lang: str = "lang", text: str = "text", common: int = COMMON) -> DataFrame:
    """Add counts, distances, ``base_failed`` and ``kept`` to every row of ``docs``.

    Counts are those of the whole text. ``base_failed``: fewer than 50 words,
    or more than half of the words in repeated three-word windows. Other
    documents are kept unless their character classes or their common words lie
    further from their language's reference than a document of that length may.
    A language of few words has a wider limit, by the uncertainty of its
    reference; its documents, as all, are also held against the character
    classes of all languages together, so that a rare or null language hides no
    junk. Guard: no distance is judged under ``MIN_WORDS`` words (such
    documents have failed already). Null texts are empty; repeated rows are
    judged alike; words of equal counts are chosen by their spelling. Columns
    added here, or whose names begin with an underscore, replace those of the same
    name.
    """
    own = stage(references(docs, lang, text, common), "references")
    pooled = own.select(F.posexplode("classes").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    pooled = [r["n"] for r in sorted(pooled)]
    reference = F.struct("n_words", "words", "counts", "classes", F.array(*map(F.lit, pooled)).cast("array<bigint>").alias("pooled"))
    table = own.select("_lang", reference.alias("_reference"))
    judged = F.arrow_udf(kernel.judge_batch, _JUDGED)
    rows = _with_language(docs.withColumn("_lang", _key(lang)), table, own.count(), "left")
    rows = rows.withColumn("_judged", judged(F.col("_lang"), F.col(text).cast("string"), F.col("_reference")))
    rows = rows.withColumn("_n_reference", F.col("_reference.n_words"))
    names = [f.name for f in kernel.JUDGED]
    rows = rows.withColumns({name: F.col(f"_judged.{name}") for name in names}).drop(
        "_judged", "_reference", "_lang"
    )
    n, known = F.col("n_words"), F.col("_n_reference")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)
    return rows.withColumn("base_failed", failed).withColumn(
        "kept",
        ~F.col("base_failed")
        & _within("class_distance", CLASS_LIMIT, n, known)
        & _within("word_distance", WORD_LIMIT, n, known)
        & _within("pooled_distance", POOLED_LIMIT, n),
    ).drop("_n_reference")
