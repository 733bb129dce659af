"""Finding windows of text that occur more than once in a corpus.

Shared by the byte and the word operator, which differ in the index they build
over the cells that need one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.llm import cells_kernel as kernel
from likeness.llm.ranks import ranked
from likeness.llm.sizes import BROADCAST_ROWS, matched, small
from likeness.plans.staging import shuffle_partitions, shuffle_tasks, stage

_CELLS = "anchor bigint, body bigint, row bigint, piece int, alone boolean, first int, count int"
_BODIES = "anchor bigint, row bigint, piece int, alone boolean, first int, count int, text binary"
_MARKS = "row bigint, `from` bigint, `to` bigint"
_SPANS = "array<struct<`from`:bigint,`to`:bigint>>"
# A mark up to here goes to the end of the text.
END = kernel.END
# Rows of cells and bytes of text that one task of a shuffle takes.
TASK_CELLS = 5_000_000
TASK_BYTES = 128 << 20


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(row, doc_id, text)`` with a number for each row, in the order of ids.

    The id itself where it is a whole number, not null and unique; else places
    in the order of id and text.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    if isinstance(own.schema["doc_id"].dataType, T.IntegralType):
        twice = own.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
        if twice.isEmpty():
            return own.select(F.col("doc_id").cast("bigint").alias("row"), "doc_id", "text")
    digest = own.withColumn("_digest", F.sha2("text", 256))
    return ranked(digest, [], ["doc_id", "_digest"], "row").select("row", "doc_id", "text")


def repeated(
    docs: DataFrame,
    unit: str,
    window: int,
    gram: int,
    index: Callable,
    first_stays: bool,
    group_cells: int,
    task_units: int,
) -> tuple[DataFrame, int]:
    """``(row, marks)``: spans of units inside windows that also occur elsewhere; and the bytes of all texts.

    With ``first_stays`` the first occurrence, by row and place, is not marked.

    Texts that are equal as a whole are found by their digests; one of them
    stands for all in what follows. Texts are cut into cells. Cells whose
    anchor occurs once hold no repeated window and go after one narrow count.
    Of equal cells all are marked (all but the first with ``first_stays``), and
    one stands for all. Only anchors with cells that differ need the texts of
    these: they are dealt out by anchor, ``task_units`` units to a task, and
    ``index`` marks their windows. Cells of anchors with more than
    ``group_cells`` different ones do not fit a task: they are cut again by
    grams twice as long, which parts them by their neighbourhood, until they
    fit; a gram as long as the window leaves no cells that differ.

    Cells are told apart by 128 bits of digests, 64 of them the anchor's, texts
    by 128 bits: among 10^12 different cells two are taken for equal with a
    chance of about one in 10^15.
    """
    spark = docs.sparkSession
    prints = stage(
        docs.select(
            "row",
            F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest"),
            F.octet_length("text").cast("bigint").alias("bytes"),
        ).filter(F.col("bytes") >= window),
        "prints",
    )
    n_rows, n_bytes = prints.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    with shuffle_partitions(spark, shuffle_tasks(spark, n_rows, TASK_CELLS)):
        copied = stage(
            prints.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1"), "copied"
        )
        copies = stage(matched(prints, copied, ["digest"], n_rows), "copies")
    gone = copies.filter("row <> first").select("row")
    marks = [(gone if first_stays else copies.select("row")).withColumns({"from": F.lit(0).cast("bigint"), "to": F.lit(END)})]
    # All but one of equal texts leave; the one that stays stands for several.
    n_copies = copies.count()
    pieces = docs.select("row", F.lit(0).alias("piece"), "text").join(
        small(copies.select("row", "first"), n_copies), "row", "left"
    )
    pieces = pieces.filter("first IS NULL OR row = first").select("row", "piece", F.col("first").isNull().alias("alone"), "text")
    if n_copies > BROADCAST_ROWS:  # a join that moves the texts, once
        pieces = stage(pieces, "different")
    level_bytes = n_bytes
    while True:
        n_cells = kernel.expected_cells(unit, level_bytes, window, gram)
        with shuffle_partitions(spark, shuffle_tasks(spark, n_cells, TASK_CELLS)):
            found, crowded = _level(pieces, unit, window, gram, index, first_stays, group_cells, task_units)
        marks += found
        if crowded is None:
            break
        pieces, level_bytes, gram = crowded, crowded.agg(F.sum(F.octet_length("text"))).first()[0], min(2 * gram, window)
    spans = reduce(DataFrame.unionByName, marks).groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("marks"))
    return spans, n_bytes


def _level(
    pieces: DataFrame,
    unit: str,
    window: int,
    gram: int,
    index: Callable,
    first_stays: bool,
    group_cells: int,
    task_units: int,
) -> tuple[list[DataFrame], DataFrame | None]:
    """Marks of the cells of ``pieces(row, piece, alone, text)``, and the crowded ones as pieces.

    A piece is a stretch of its row's text, from unit ``piece`` on; one that is
    not ``alone`` has marks already and is only matched against.
    """
    cut = partial(kernel.cell_batches, unit=unit, window=window, gram=gram)
    # Cells are cut twice and not written: they would take as much disk as the
    # texts, and cutting them again costs less.
    often = stage(
        pieces.mapInArrow(partial(cut, anchors_only=True), "anchor bigint")
        .groupBy("anchor")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("anchor"),
        "anchors",
    )
    shared = stage(pieces.mapInArrow(cut, _CELLS).join(often, "anchor", "left_semi"), "shared_cells")
    bodies = stage(
        shared.groupBy("anchor", "body").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "first", "piece", "count", "alone")).alias("at")
        ),
        "bodies",
    )
    twice = bodies.filter("n > 1").select(
        "anchor", "body", "n", F.col("at.row").alias("_row"), F.col("at.first").alias("_first")
    )
    copies = matched(shared, twice, ["anchor", "body"], shared.count())
    if first_stays:
        copies = copies.filter("row <> _row OR first <> _first")
    to = F.col("first") + F.col("count") + F.lit(window - 1)
    copies = copies.select("row", F.col("first").cast("bigint").alias("from"), to.cast("bigint").alias("to"))
    marks = [stage(copies, "copy_marks")]

    contested = stage(
        bodies.groupBy("anchor").agg(F.count("*").alias("n_bodies")).filter("n_bodies > 1"), "contested"
    )
    wanted = stage(
        bodies.join(contested, "anchor").select(
            "anchor",
            "at.row",
            "at.piece",
            "at.first",
            "at.count",
            ((F.col("n") == 1) & F.col("at.alone")).alias("alone"),
            (F.col("n_bodies") > group_cells).alias("crowded"),
        ),
        "wanted",
    )
    units = {
        crowded: total
        for crowded, total in wanted.groupBy("crowded").agg(F.sum(F.col("count") + window - 1)).collect()
    }
    if False in units:
        tasks = max(1, -(-units[False] // task_units))
        texts = _bodies(pieces, wanted.filter("NOT crowded"), unit, window)
        found = texts.repartition(tasks, "anchor").mapInArrow(partial(index, window=window), _MARKS)
        marks.append(stage(found, "index_marks"))
    if True not in units:
        return marks, None
    texts = _bodies(pieces, wanted.filter("crowded"), unit, window)
    return marks, stage(texts.select("row", F.col("first").alias("piece"), "alone", "text"), "crowded")


def _bodies(pieces: DataFrame, wanted: DataFrame, unit: str, window: int) -> DataFrame:
    """Fetch the texts of cells; all of a piece's at once."""
    lists = stage(
        wanted.groupBy("row", "piece").agg(
            F.collect_list(F.struct("anchor", "first", "count", "alone")).alias("wanted")
        ),
        "wanted_rows",
    )
    joined = pieces.drop("alone").join(lists, ["row", "piece"])
    return joined.select("row", "piece", "text", "wanted").mapInArrow(
        partial(kernel.body_batches, unit=unit, window=window), _BODIES
    )


def cut_out(docs: DataFrame, marks: DataFrame, n_bytes: int, unit: str, window: int) -> DataFrame:
    """``(doc_id, n, spans, kept)`` for every row of ``docs(row, doc_id, text)``, which has so many bytes."""
    held = stage(marks, "marks")
    tasks = shuffle_tasks(docs.sparkSession, n_bytes, TASK_BYTES)
    if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        docs = docs.repartition(tasks, "row")

    def batch(texts, found):
        return kernel.cut_batch(texts, found, unit, window)

    cut = F.arrow_udf(batch, f"struct<n:bigint,spans:{_SPANS},kept:binary>")
    return (
        docs.join(held, "row", "left")
        .withColumn("_cut", cut(F.col("text"), F.col("marks")))
        .select("doc_id", "_cut.n", "_cut.spans", "_cut.kept")
    )


def removed() -> Column:
    lengths = F.transform("spans", lambda s: s["to"] - s["from"])
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b)
