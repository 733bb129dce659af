"""Long repeated byte strings, marked through a run-length index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm import cells
from likeness.llm.run_index_kernel import index_batches

WINDOW = 400
# Bytes of an anchor: longer ones bring fewer chance meetings and more cells.
GRAM = 128
# Different cells of an anchor that still go to one task, about half a KB each.
GROUP_CELLS = 8_000
TASK_BYTES = 2 << 20


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    group_cells: int = GROUP_CELLS,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """``(doc_id, n, spans, kept)`` for every row of ``docs``.

    Bytes of the UTF-8 text covered by a string of ``window`` bytes that starts
    at any other place too, in any row, are removed; overlapping occurrences
    count, and strings are judged on the input. ``spans`` are the maximal
    removed runs ``[from, to)``, ``kept`` the bytes left, which may cut a
    character. Null texts are empty. A repeated row is a text of its own, so
    both go if they are long enough. Ids may repeat or be null. Columns beyond
    the two named are left aside.

    Texts that may repeat come together by anchors (see ``cells``). A task
    builds the run-compressed Burrows-Wheeler transform of its share, with the
    common prefixes sampled at run ends, and streams the texts through it.
    """
    rows = cells.numbered(docs, doc_id, text)
    marks, n_bytes = cells.repeated(
        rows, "bytes", window, gram, index_batches, False, group_cells, task_bytes
    )
    return cells.cut_out(rows, marks, n_bytes, "bytes", window)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        cells.removed().alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
