"""Collocations of a corpus, counted in counting quotient filters."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm import phrases_kernel as kernel
from likeness.llm import quotient_filter as qf
from likeness.llm.ranks import ranked
from likeness.llm.sizes import small
from likeness.plans.staging import shuffle_tasks, stage

LONGEST = 4
MIN_COUNT = 30
TOP = 2_000
# A phrase goes if a longer one has at least this share (in hundredths) of its
# occurrences.
COVERED = 80
NO_LANGUAGE = "und"
# Bytes of filters that one task merges; a key takes some four of them.
MERGE_BYTES = 2 << 20
KEY_BYTES = 4
# Bits by which a filter is parted at a time: a thousand parts of a few KB.
SPLIT_BITS = 10
# Parts that a task merges one after the other.
TASK_PARTS = 16
# A phrase and its count take as much as so many narrow rows in a broadcast.
PART_ROWS = 10

_CHUNKS = "shard bigint, lang string, word binary, number int, n bigint, lead int, codes binary"
_FILTERS = "words int, head bigint, shard bigint, filter binary"


def mine(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    top: int = TOP,
    longest: int = LONGEST,
    chunk_bytes: int = kernel.CHUNK_BYTES,
    merge_bytes: int = MERGE_BYTES,
    split_bits: int = SPLIT_BITS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into
    pieces, these at blanks and tabs into words. A phrase is two to ``longest``
    words of one piece and occurs ``a >= min_count`` times in its language,
    overlaps included. Of its cuts in two the one of least
    ``floor(2000000 * a / (l + r))`` counts, the first of equal ones. Phrases
    inside a longer one that has ``COVERED`` hundredths of their occurrences
    are left out. Order is by score and ``a`` from above, then phrase. A null
    language is ``und``; a null or empty text has no words, repeated rows count
    each time, and an empty table gives no rows. Other columns are left aside.

    Texts are read once and kept as numbers of each chunk's own words. Words
    that occur ``min_count`` times in their language get a number in the corpus
    by joins; no dictionary goes to the driver or to all tasks. Each chunk
    counts its phrases in filters (see ``quotient_filter``), which are merged
    by the first bits of their keys: the permutation spreads those evenly,
    whatever phrase is hot.
    """
    spark = docs.sparkSession
    chunks = stage(
        docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)), F.col(text).cast("string")).mapInArrow(
            partial(kernel.chunk_batches, longest=longest, size=chunk_bytes), _CHUNKS
        ),
        "chunks",
    )
    words = chunks.filter("word IS NOT NULL")
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    known = stage(
        ranked(counts, [], ["lang", "word"], "id").select("lang", "word", "n", (F.col("id") + 1).alias("id")), "words"
    )
    n_known = known.count()
    bits = max(1, n_known.bit_length())
    if qf.halves(longest, bits)[0] > qf.HALF_BITS:
        raise ValueError(f"{n_known} words or phrases of {longest} words do not fit a key")
    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts_bits = min(bits, max(0, -(-n_words * KEY_BYTES // merge_bytes) - 1).bit_length())
    grams = stage(_counted(chunks, words, known, longest, bits, parts_bits, split_bits, min_count), "phrases")
    return _best(grams, known, totals, top)


def _merging(bits, prefix, more):
    return lambda table: kernel.merge_filters(table, bits, prefix, more)


def _counted(chunks, words, known, longest, bits, parts_bits, split_bits, min_count) -> DataFrame:
    """``(ids, a)`` of the frequent phrases."""
    spark = chunks.sparkSession
    table = small(known.select("lang", "word", "id"), known.count())
    numbers = words.select("shard", "lang", "word", "number").join(table, ["lang", "word"]).select("shard", "number", "id")
    coded = chunks.filter("codes IS NOT NULL").select(F.col("shard").alias("chunk"), "lead", "codes")
    done = min(split_bits, parts_bits)

    def count(chunk, known_numbers):
        return kernel.count_shard(chunk, known_numbers, longest, bits, done)

    filters = coded.groupBy("chunk").cogroup(numbers.groupBy("shard")).applyInArrow(count, _FILTERS)
    while done < parts_bits:
        # Too many parts to go to at once: chunks in bundles, each as large as
        # a last part, and a thousand parts further at a time.
        more = min(split_bits, parts_bits - done)

        bundle = F.pmod(F.xxhash64("shard"), F.lit(1 << (parts_bits - done))).alias("bundle")
        filters = stage(
            filters.select("words", "head", bundle, "filter")
            .groupBy("words", "head", "bundle")
            .applyInArrow(_merging(bits, done, more), _FILTERS),
            "filters",
        )
        done += more

    def frequent(table):
        return kernel.frequent_phrases(table, bits, parts_bits, min_count)

    tasks = shuffle_tasks(spark, (longest - 1) << parts_bits, TASK_PARTS)
    return (
        filters.repartition(tasks, "words", "head").groupBy("words", "head").applyInArrow(frequent, "ids array<bigint>, a bigint")
    )


def _best(grams: DataFrame, known: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    parts = stage(
        grams.unionAll(known.select(F.array("id").alias("ids"), F.col("n").alias("a"))).withColumnRenamed("a", "f"),
        "parts",
    )
    table = small(parts, parts.count() * PART_ROWS)
    size = F.size("ids")
    cuts = (
        grams.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
        .select(
            "ids",
            "a",
            "k",
            F.slice("ids", F.lit(1), F.col("k")).alias("first"),
            F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("rest"),
        )
        .join(table.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first")
        .join(table.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    )
    # Past 63 bits in between: as decimals, of which ``div`` gives a whole number.
    score = F.expr("CAST(a AS DECIMAL(19,0)) * 2000000 div CAST(l + r AS DECIMAL(19,0))")
    scored = cuts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.slice("ids", s, m)),
        )
    )
    longer = (
        grams.filter(size > 2)
        .select(F.explode(inner).alias("ids"), "a")
        .groupBy("ids")
        .agg(F.max("a").alias("longest"))
    )
    kept = scored.join(longer, "ids", "left").filter(
        F.coalesce(100 * F.col("longest") < COVERED * F.col("a"), F.lit(True))
    )
    langs = small(known.select(F.col("id").alias("_id"), "lang"), known.count())
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = stage(
        kept.withColumn("_id", F.col("ids")[0])
        .join(langs, "_id")
        .select("lang", "ids", "a", "cut.score", "cut.l", "cut.r")
        .withColumn("_tie", F.rank().over(ordered))
        .filter(F.col("_tie") <= top),
        "best",
    )
    spelled = (
        first.select("ids", F.posexplode("ids").alias("_at", "id"))
        .join(known.select("id", F.col("word").cast("string").alias("word")), "id")
        .groupBy("ids")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("words"))
        .select("ids", F.array_join(F.col("words.word"), " ").alias("phrase"))
    )
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        first.join(spelled, "ids")
        .withColumn("rank", F.row_number().over(last).cast("bigint"))
        .filter(F.col("rank") <= top)
        .join(small(totals, totals.count()), "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
