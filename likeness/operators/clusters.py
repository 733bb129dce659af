"""Edges between similar items and their one-hop clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.text import sentence_id
from likeness.operators.skew import lookup_join


def star_edges(members: DataFrame) -> DataFrame:
    """Both directions of hub--member for every bucket, each edge once.

    Output is linear in the bucket size. Edges are made distinct in one
    direction and mirrored afterwards, so only half of them are shuffled.
    """
    is_hub = F.col("doc_id").eqNullSafe(F.col("hub_doc")) & F.col("ord").eqNullSafe(F.col("hub_ord"))
    spokes = members.filter(~is_hub).select(
        sentence_id(F.col("hub_doc"), F.col("hub_ord")).alias("src"),
        sentence_id(F.col("doc_id"), F.col("ord")).alias("dst"),
    )
    return _mirror(spokes.distinct())


def pair_edges(pairs: DataFrame) -> DataFrame:
    """Both directions of every ``(id_a, id_b)`` pair, each edge once."""
    return _mirror(
        pairs.filter("id_a <> id_b")
        .select(
            F.least("id_a", "id_b").cast("string").alias("src"),
            F.greatest("id_a", "id_b").cast("string").alias("dst"),
        )
        .distinct()
    )


def _mirror(edges: DataFrame) -> DataFrame:
    there = F.struct("src", "dst")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = F.array(there, back)
    return edges.select(F.inline(both))


def large_nodes(edges: DataFrame, max_neighbours: int) -> DataFrame:
    """``(node, neighbours)`` of nodes with more than ``max_neighbours``."""
    return (
        edges.groupBy(F.col("src").alias("node"))
        .agg(F.count("*").alias("neighbours"))
        .filter(F.col("neighbours") > max_neighbours)
    )


def one_hop_clusters(edges: DataFrame) -> DataFrame:
    """``(node, size, part, parts, members)``: each node with its neighbours.

    ``edges`` must be distinct. Every node has one part, number 0.
    """
    return (
        edges.groupBy(F.col("src").alias("node"))
        .agg(F.collect_set("dst").alias("members"))
        .select(
            "node",
            (F.size("members") + 1).cast("bigint").alias("size"),
            F.lit(0).alias("part"),
            F.lit(1).alias("parts"),
            member_text(F.array_append("members", F.col("node"))).alias("members"),
        )
    )


def clusters_in_parts(
    edges: DataFrame,
    large: DataFrame,
    part_members: int,
    fits: bool = True,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One-hop clusters where ``large`` nodes (from large_nodes) take many rows.

    No cell and no task can hold a neighbourhood of any size, so the members of
    a large node go to as many ``parts`` of about ``part_members`` as it takes,
    by a hash of the member. Every part from 0 to parts - 1 has a row that
    names the node, also one that no member falls into; ``size`` is the size of
    the whole cluster in each. ``fits`` and ``hot`` are those of lookup_join.
    """
    parts = F.ceil((F.col("neighbours") + 1) / F.lit(part_members)).cast("int")
    sized = large.withColumn("parts", parts)
    part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"), F.lit(0))
    neighbour_rows = (
        lookup_join(edges.withColumnRenamed("src", "node"), sized, "node", fits, hot)
        .unionByName(sized.withColumn("dst", F.col("node")))
        .withColumn("part", part)
    )
    every_part = sized.select(
        "node",
        F.lit(None).cast("string").alias("dst"),
        "neighbours",
        "parts",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    members = F.when(
        F.col("neighbours").isNull(), F.array_append("members", F.col("node"))
    ).otherwise(F.col("members"))
    return (
        neighbour_rows.unionByName(every_part)
        .groupBy("node", "part")
        .agg(
            F.first("neighbours").alias("neighbours"),
            F.first("parts").alias("parts"),
            F.collect_set("dst").alias("members"),
        )
        .select(
            "node",
            (F.coalesce("neighbours", F.size("members")) + 1).cast("bigint").alias("size"),
            "part",
            F.coalesce("parts", F.lit(1)).alias("parts"),
            member_text(members).alias("members"),
        )
    )


def member_text(members: Column) -> Column:
    return F.array_join(F.array_sort(members), ", ")
