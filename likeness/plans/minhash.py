"""MinHash jobs: documents to buckets, edges and clusters."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.operators import buckets as B
from likeness.operators import clusters as C
from likeness.operators.minhash import signature_of, signatures, with_minhash
from likeness.operators.sentences import candidates
from likeness.operators.skew import BROADCAST_KEYS, GROUP_ROWS, hot_routes, route_counts
from likeness.params import MinHashParams
from likeness.plans.staging import shuffle_partitions, shuffle_tasks, stage

# Sentences that one task of a shuffle takes.
TASK_SENTENCES = 1_000_000
# Rows of ids and hashes that one task sorts.
TASK_PLACES = 2_000_000
MEMBERS = ["draw", "sig", "doc_id", "ord", "bucket_size", "hub_doc", "hub_ord"]


def minhash_vectors(
    documents: DataFrame, params: MinHashParams = MinHashParams(), family: str = "multiply_shift"
) -> DataFrame:
    """``(doc_id, ord, sentence, mh)`` of the sentences within bounds; lazy."""
    return with_minhash(candidates(documents, params), params, family)


class BucketJob:
    """Buckets of one corpus, with the hashing done and written once.

    Splitting and hashing cost far more than reading their result back, and
    three passes need it: the counts of signatures, the bucket shuffle, and the
    join that brings the text back. Every staged sentence has a row number, so
    document ids may repeat.
    """

    def __init__(
        self,
        documents: DataFrame,
        params: MinHashParams = MinHashParams(),
        group_rows: int = GROUP_ROWS,
    ):
        self.params = params
        self.group_rows = group_rows
        numbered = minhash_vectors(documents, params).withColumn(
            "row", F.monotonically_increasing_id()
        )
        self.vectors = stage(numbered, "minhash")

    def signatures(self) -> DataFrame:
        return signatures(self.vectors, self.params)

    @cached_property
    def shared(self) -> DataFrame:
        """``(route, n)`` of the signatures that more than one row may have."""
        counts = route_counts(B.marked(self.signatures()), B.KEYS)
        spark = self.vectors.sparkSession
        with shuffle_partitions(spark, shuffle_tasks(spark, self.vectors.count() * self.params.draws)):
            return stage(counts.filter("n > 1"), "shared_routes")

    def places(self) -> DataFrame:
        """``(draw, doc_id, ord, row, mark, bucket_size, hub_doc, hub_ord, hub_row)`` of shared buckets.

        Signatures stay behind: two hashes stand for them in the shuffle. Rows
        of buckets of one are left out before it if the list of shared routes
        can be broadcast; a join by shuffle would cost more than it saves.
        """
        rows = B.marked(self.signatures())
        n, total = self.shared.agg(F.count("*"), F.sum("n")).first()
        if n <= BROADCAST_KEYS:
            rows = B.shared_rows(rows, self.shared.select("route"))
        else:
            total = self.vectors.count() * self.params.draws
        tasks = shuffle_tasks(self.vectors.sparkSession, total or 0, TASK_PLACES)
        return B.bucket_members(rows, hot_routes(self.shared, self.group_rows), tasks, ["mark"])

    def members(self) -> DataFrame:
        """``(draw, sig, doc_id, ord, row, bucket_size, hub_doc, hub_ord, hub_row)`` of shared buckets."""
        return self._with("mh").withColumn("sig", self._signature()).select(*MEMBERS[:4], "row", *MEMBERS[4:], "hub_row")

    def member_sentences(self) -> DataFrame:
        """The members with their text."""
        return self._with("mh", "sentence").withColumn("sig", self._signature()).select(*MEMBERS, "sentence")

    def _signature(self) -> Column:
        return signature_of(self.params, F.col("mh"), F.col("draw"))

    def _with(self, *columns: str) -> DataFrame:
        """Places with columns of the vectors; either side in tasks of ``TASK_SENTENCES``."""
        spark = self.vectors.sparkSession
        places, vectors = self.places(), self.vectors
        shared = self.shared.agg(F.sum("n")).first()[0] or 0
        tasks = shuffle_tasks(spark, max(shared, vectors.count()), TASK_SENTENCES)
        if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
            places, vectors = places.repartition(tasks, "row"), vectors.repartition(tasks, "row")
        return B.attach_by_row(places, vectors, *columns)

    def edges(self) -> DataFrame:
        return C.star_edges(self.places())


def clusters(
    edges: DataFrame,
    max_neighbours: int = 100_000,
    broadcast_nodes: int = 1_000_000,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One-hop clusters of distinct edges, large neighbourhoods in parts.

    The edges are written once and counted: fewer than ``max_neighbours`` of
    them make no large node. Otherwise the large nodes (at most total /
    max_neighbours) are counted too, and broadcast up to ``broadcast_nodes``.
    The rows are the same on every way, one for each node unless it is large.
    """
    staged = stage(edges, "edges")
    total = staged.count()
    if total <= max_neighbours:
        return C.one_hop_clusters(staged)
    large = stage(C.large_nodes(staged, max_neighbours), "large_nodes")
    if large.count() <= broadcast_nodes:
        return C.clusters_in_parts(staged, large, max_neighbours)
    counts = stage(route_counts(staged, ["src"]).filter(F.col("n") > group_rows), "hot_nodes")
    return C.clusters_in_parts(staged, large, max_neighbours, False, hot_routes(counts, group_rows))
