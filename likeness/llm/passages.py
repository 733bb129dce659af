"""Repeated passages, found by suffix automata of reference shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm import cells
from likeness.llm.automaton_kernel import index_batches

WINDOW = 20
GRAM = 6
# Different cells of an anchor that still go to one task, about 25 words each.
GROUP_CELLS = 2_000
# Words of a reference shard; its automaton takes about half a KB for each.
SHARD_WORDS = 50_000


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    group_cells: int = GROUP_CELLS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``(doc_id, n, spans, kept)`` for every row of ``docs``.

    A word covered by a window of ``window`` consecutive words that also starts
    earlier - in a document of smaller id, or before in the same - is removed;
    windows are judged on the input. ``spans`` are the maximal removed runs
    ``[from, to)`` of word numbers, ``kept`` the other words, joined by one
    blank, in UTF-8. Null texts have no words. Of rows with equal ids the order
    is that of a digest of the text; null ids come first. Columns beyond the
    two named are left aside.

    Words of different documents come together by anchors (see ``cells``). The
    texts of a shard are its reference and its stream at once: its automaton is
    built in the order of documents, and every word read gives the matching
    statistic against all that came before it.
    """
    rows = cells.numbered(docs, doc_id, text)
    marks, n_bytes = cells.repeated(rows, "words", window, gram, index_batches, True, group_cells, shard_words)
    return cells.cut_out(rows, marks, n_bytes, "words", window)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id",
        F.col("n").alias("n_words"),
        cells.removed().alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
