"""Token totals by source, language and tokenizer, kept up by signed deltas."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

# Counters by tokenizer version. Any function from a text column to a number
# will do, also one that counts BPE tokens.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "words-2": lambda text: F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~]")),
}


def count_tokens(text: Column, tokenizers: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """``map<tokenizer, tokens>`` of a text; a null text has none."""
    own = F.coalesce(text, F.lit(""))
    pairs = (
        part
        for name, count in (tokenizers or TOKENIZERS).items()
        for part in (F.lit(name), count(own).cast("bigint"))
    )
    return F.create_map(*pairs)


def delta(changes: DataFrame) -> DataFrame:
    """Signed totals of ``changes(sign, source, lang, tokens)``.

    ``tokens`` comes from ``count_tokens``. ``sign`` is 1 for a document that
    came and -1 for one that went; a revised document is both, with its old
    counts and its new ones. Null keys are keys of their own, a null sign
    counts for nothing and null counts are no tokens. Sums are made before the
    shuffle, so a source of a third of all rows is as good as any other.
    """
    sign = F.coalesce(F.col("sign"), F.lit(0)).cast("bigint")
    rows = changes.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        sign.alias("sign"),
        F.explode("tokens").alias("tokenizer", "n"),
    )
    return rows.groupBy(*KEYS).agg(
        F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n", F.lit(0))).alias("n_tokens")
    )


class Rollup:
    """Totals in a folder: one sub-folder for each committed batch of deltas.

    A batch is written under a temporary name and renamed in one step; a batch
    whose name is there already is left alone, so a batch may be sent again
    after any failure. Totals are sums and do not depend on the order of
    batches. ``compact`` adds batches up in a snapshot and names them beside it;
    names of batches are all that passes the driver.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[str]:
        root = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root))

    def _commit(self, tables: dict[str, DataFrame], kind: str, name: str) -> bool:
        """Write tables below a temporary folder and give it its name in one step."""
        final = self._path(f"{self.folder}/{kind}/{name}")
        if self._fs.exists(final):
            return False
        temporary = f"{self.folder}/_temporary/{uuid.uuid4().hex}"
        for table, rows in tables.items():
            rows.write.parquet(f"{temporary}/{table}")
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final):  # another writer of the same batch was faster
            self._fs.delete(self._path(temporary), True)
            return False
        if not self._fs.rename(self._path(temporary), final):
            raise OSError(f"cannot commit {final}")
        return True

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of ``changes`` (see ``delta``); False if it was committed before."""
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"{batch!r} cannot name a batch")
        if batch in self._included() or self._fs.exists(self._path(f"{self.folder}/deltas/{batch}")):
            return False
        return self._commit({"totals": delta(changes)}, "deltas", batch)

    def _included(self) -> set[str]:
        done = self._committed("snapshots")
        if not done:
            return set()
        names = self.spark.read.parquet(f"{self.folder}/snapshots/{done[-1]}/batches")
        return {row[0] for row in names.collect()}

    def _parts(self) -> list[DataFrame]:
        included, snapshots = self._included(), self._committed("snapshots")
        read = self.spark.read.schema(TOTALS)
        parts = [read.parquet(f"{self.folder}/snapshots/{snapshots[-1]}/totals")] if snapshots else []
        fresh = [b for b in self._committed("deltas") if b not in included]
        if fresh:
            parts.append(read.parquet(*(f"{self.folder}/deltas/{b}/totals" for b in fresh)))
        return parts

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)``; keys that went back to nothing are gone."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], TOTALS)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return (
            rows.groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .filter("n_docs <> 0 OR n_tokens <> 0")
        )

    def compact(self) -> None:
        """Write the totals so far as one snapshot; later reads start from it."""
        batches = sorted(self._included() | set(self._committed("deltas")))
        names = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        number = len(self._committed("snapshots"))
        self._commit({"totals": self.totals(), "batches": names}, "snapshots", f"{number:09d}")
