"""Sentences that share a signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.operators.skew import few, route, routed, split_hot
from likeness.plans.staging import stage

KEYS = ["draw", "sig"]


def marked(signature_rows: DataFrame) -> DataFrame:
    """``route`` and ``mark`` in place of ``sig``: two 64-bit hashes of draw and signature.

    Together they stand for the bucket as a digest of 128 bits does, at a
    fraction of the width of the values; what meets by the route alone, or by
    the mark alone, stays apart.
    """
    ids = [c for c in signature_rows.columns if c not in KEYS]
    mark = route(F.lit("mark"), F.reverse("sig"), "draw").alias("mark")
    return signature_rows.select("draw", *ids, route(*KEYS).alias("route"), mark)


def shared_rows(signature_rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows whose routing hash is in ``shared(route)``.

    With the routes that occur more than once, these are all rows of shared
    buckets and, by a clash of hashes, hardly any other; the wide rows of
    buckets of one are not shuffled if the list is small. A ``route`` that the
    rows have stays.
    """
    kept = routed(signature_rows, KEYS).join(few(shared), "route", "left_semi")
    return kept.select(*signature_rows.columns)


def bucket_members(
    signature_rows: DataFrame,
    hot: DataFrame | None = None,
    tasks: int | None = None,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Members of every bucket of two or more sentences; rows equal in ``keys`` and route are a bucket.

    Adds ``bucket_size`` and the hub, the smallest ``(doc_id, ord)`` of the
    bucket, as ``hub_doc`` and ``hub_ord``; rows with a ``row`` number also get
    the hub's, ``hub_row``. Without hot keys this is one
    shuffle, of ``tasks`` partitions if given, and one sort. The buckets named
    by ``hot`` never meet in one task: they are counted with a map-side
    combine, and the counts (about one row per hot key) go back by a join.
    """
    if hot is None:
        return _by_window(routed(signature_rows, keys), tasks, keys)
    hot_rows, other_rows = split_hot(signature_rows, keys, hot)
    bucket = ["route", *keys]
    sizes = (
        hot_rows.groupBy(*bucket)
        .agg(
            F.count("*").alias("bucket_size"),
            F.min(F.struct(*_places(signature_rows))).alias("hub"),
        )
        .filter("bucket_size > 1")
        .select(*bucket, "bucket_size", *(F.col(f"hub.{c}").alias(name) for c, name in _places(signature_rows).items()))
    )
    # About as many rows as hot routes; few() counts them.
    hot_members = hot_rows.join(few(stage(sizes, "hot_sizes")), bucket).drop("route")
    return _by_window(other_rows, tasks, keys).unionByName(hot_members)


def _places(rows: DataFrame) -> dict[str, str]:
    """What orders the members of a bucket, and what it is called for the hub."""
    names = {"doc_id": "hub_doc", "ord": "hub_ord", "row": "hub_row"}
    return {c: name for c, name in names.items() if c in rows.columns}


def _by_window(routed_rows: DataFrame, tasks: int | None, keys: list[str]) -> DataFrame:
    if tasks is not None:
        routed_rows = routed_rows.repartition(tasks, "route", *keys)
    # The route comes first in the sort: a long that settles nearly every
    # comparison, where a signature would be compared value by value.
    bucket = (
        Window.partitionBy("route", *keys)
        .orderBy(*_places(routed_rows))
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    hub = {name: F.first(c).over(bucket) for c, name in _places(routed_rows).items()}
    return (
        routed_rows.withColumns({"bucket_size": F.count("*").over(bucket), **hub})
        .filter("bucket_size > 1")
        .drop("route")
    )


def bucket_sizes(signature_rows: DataFrame) -> DataFrame:
    """``(draw, sig, bucket_size)`` of every bucket of two or more sentences.

    Plain grouping: the map-side combine sends one row per key and task.
    """
    return (
        signature_rows.groupBy(*KEYS)
        .agg(F.count("*").alias("bucket_size"))
        .filter("bucket_size > 1")
    )


def attach_by_row(members: DataFrame, sentence_rows: DataFrame, *columns: str) -> DataFrame:
    """Bring columns back by row number, after the bucket shuffle.

    Document ids may repeat, rows do not.
    """
    return members.join(sentence_rows.select("row", *columns), "row")
