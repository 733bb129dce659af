"""Registered queries, each with the DuckDB statement that must agree with it."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import partial

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_sql as sql
from likeness.functions.sql import register
from likeness.functions.text import clean_tokens
from likeness.operators import minhash as mh
from likeness.operators.buckets import bucket_sizes
from likeness.operators.clusters import pair_edges
from likeness.operators.projection import signature_bits
from likeness.operators.sentences import length_filter, sentences, shingle_counts
from likeness.operators.vectors import micros as mean_micros
from likeness.operators.vectors import token_lists
from likeness.params import MinHashParams, ProjectionParams
from likeness.plans import jobs
from likeness.plans.components import connected_components
from likeness.plans.minhash import BucketJob, clusters, minhash_vectors
from likeness.plans.projection import projection_neighbours, projection_signatures
from likeness.plans.reading import set_aside
from likeness.plans.staging import fresh_path, leased, spread, stage, tidy
from likeness.plans.store import SignatureStore
from likeness.plans.training import train_word_vectors
from likeness.plans.vectors import held_tokens, projection_input, sentence_vectors
from likeness.plans.verification import verified_pairs
from likeness.sources import text as files

try:
    from likeness.llm import queries as llm
except ImportError as error:
    # The folder of the training-data operators may be absent as a whole.
    if error.name not in ("likeness.llm", "corpus_pipeline"):
        raise
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"

MINHASH = MinHashParams()
# The given embeddings have 64 values; only their closest pairs differ in
# fewer than 35 of 100 bits.
EMBEDDINGS = ProjectionParams(vec_len=64, threshold=35)
# Word vectors are derived from the words of the documents.
WORD_DIMS = 32
SENTENCE_POINTS = ProjectionParams(vec_len=WORD_DIMS)
ALL_POINTS = ProjectionParams(vec_len=WORD_DIMS, rounds=2, keep_zero_vectors=True)
# Limits that send part of the small tables down the ways for large ones.
HOT_ROWS = 20
PART_MEMBERS = 3
ROUND_ROWS, CELL_ROWS = 100, 64
SLICE_BYTES = 512 << 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return spread(table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


def all_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(documents(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_filter(all_sentences(spark, sf_dir), MINHASH)


def word_bases(sentence_rows: DataFrame) -> DataFrame:
    """A number per word, from its md5; words whose digest starts with f are left out."""
    words = token_lists(sentence_rows).select(F.explode("words").alias("word"))
    digest = words.distinct().withColumn("digest", F.md5("word"))
    return digest.filter(F.substring("digest", 1, 1) != "f").select(
        "word", F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint").alias("base")
    )


def word_values(bases: DataFrame) -> DataFrame:
    """The vector of each word, from its number."""
    values = [
        (((F.col("base") * a + b) % sql.PRIME) / F.lit(sql.HALF_PRIME) - 1).cast("float")
        for a, b in sql.word_coefficients(WORD_DIMS)
    ]
    return bases.select("word", F.array(*values).alias("vec"))


def word_table(sentence_rows: DataFrame) -> DataFrame:
    return word_values(word_bases(sentence_rows))


# -- sentences and shingles --------------------------------------------------


def q_shingle_counts(spark, sf_dir):
    return shingle_counts(candidates(spark, sf_dir), MINHASH)


# -- MinHash, buckets, clusters ----------------------------------------------


def vectors(spark, sf_dir, family="multiply_shift"):
    return minhash_vectors(documents(spark, sf_dir), MINHASH, family)


def q_minhash_vectors(spark, sf_dir, family="multiply_shift"):
    return mh.minhash_values(vectors(spark, sf_dir, family))


def q_minhash_single_fn(spark, sf_dir):
    return mh.single_function(vectors(spark, sf_dir), 3)


def q_minhash_argmin(spark, sf_dir):
    return mh.argmin_shingles(candidates(spark, sf_dir), MINHASH)


def with_signature_text(df: DataFrame) -> DataFrame:
    return df.withColumn("sig", mh.signature_text(F.col("sig")))


def q_minhash_signatures(spark, sf_dir):
    return with_signature_text(mh.signatures(vectors(spark, sf_dir), MINHASH))


def q_minhash_buckets(spark, sf_dir, **limits):
    job = BucketJob(documents(spark, sf_dir), MINHASH, **limits)
    return with_signature_text(job.member_sentences()).select(
        "draw", "sig", "doc_id", "ord", "bucket_size", "sentence"
    )


def q_minhash_bucket_sizes(spark, sf_dir):
    return with_signature_text(bucket_sizes(mh.signatures(vectors(spark, sf_dir), MINHASH)))


def q_star_edges(spark, sf_dir):
    return BucketJob(documents(spark, sf_dir), MINHASH).edges()


def q_neighbour_clusters(spark, sf_dir):
    return clusters(BucketJob(documents(spark, sf_dir), MINHASH).edges())


def q_neighbour_clusters_parts(spark, sf_dir):
    """Clusters in small parts, put together again."""
    edges = BucketJob(documents(spark, sf_dir), MINHASH).edges()
    parts = clusters(edges, PART_MEMBERS, broadcast_nodes=0, group_rows=HOT_ROWS)
    members = F.array_remove(F.flatten(F.collect_list(F.split("members", ", "))), "")
    return parts.groupBy("node").agg(
        F.first("size").alias("size"), F.array_join(F.array_sort(members), ", ").alias("members")
    )


def q_bucket_components(spark, sf_dir):
    """Transitive clusters of the sentences that share buckets."""
    return connected_components(BucketJob(documents(spark, sf_dir), MINHASH).edges())


def q_minhash_buckets_in_batches(spark, sf_dir, **limits):
    """Buckets over two batches, English texts and all others, the first of them laid out for good."""
    store = SignatureStore(spark, fresh_path(spark, "signatures"), MINHASH, slices=8)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("lang").eqNullSafe("en").alias("english"))
    store.add("english", docs.filter("english").select("doc_id", "text"))
    store.add("others", docs.filter("NOT english").select("doc_id", "text"))
    return with_signature_text(store.members(**limits)).select("draw", "sig", "doc_id", "ord", "bucket_size")


def q_verified_pairs(spark, sf_dir, **limits):
    return verified_pairs(BucketJob(documents(spark, sf_dir), MINHASH), **limits)


# -- random projection -------------------------------------------------------


def q_rp_signatures(spark, sf_dir):
    return projection_signatures(embeddings(spark, sf_dir), EMBEDDINGS).withColumn(
        "sig", signature_bits(F.col("sig"), EMBEDDINGS)
    )


def q_rp_neighbours(spark, sf_dir, **limits):
    return projection_neighbours(embeddings(spark, sf_dir), EMBEDDINGS, **limits)


def q_rp_clusters(spark, sf_dir):
    return clusters(pair_edges(q_rp_neighbours(spark, sf_dir)))


def q_rp_components(spark, sf_dir):
    """Transitive clusters of the vectors that are close, by the way for large tables."""
    edges = pair_edges(q_rp_neighbours(spark, sf_dir))
    return connected_components(edges, group_rows=HOT_ROWS, broadcast_nodes=0)


# -- tokens and sentence vectors ---------------------------------------------


def q_clean_tokens(spark, sf_dir):
    return all_sentences(spark, sf_dir).select(
        "doc_id", "ord", F.array_join(clean_tokens(F.col("sentence")), " ").alias("tokens")
    )


def word_means(spark, sf_dir, **limits):
    # Cleaned once, for the word table and for the sums.
    rows = held_tokens(all_sentences(spark, sf_dir))
    with tidy(spark):
        bases = stage(word_bases(rows), "words")
    return sentence_vectors(rows, word_values(bases), WORD_DIMS, **limits)


def q_trained_sentence_vectors(spark, sf_dir):
    """Mean vectors by a word table trained on the sentences of all documents."""
    rows = held_tokens(all_sentences(spark, sf_dir))
    return sentence_vectors(rows, train_word_vectors(rows, WORD_DIMS), WORD_DIMS)


def micros(vec):
    """Values in millionths, as text: independent of how floats are printed."""
    whole = F.transform(vec, lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    return F.array_join(whole, ",")


def q_sentence_vectors(spark, sf_dir, **limits):
    return word_means(spark, sf_dir, **limits).withColumn("vec", mean_micros(F.col("vec")))


def q_sentence_vector_neighbours(spark, sf_dir):
    points = projection_input(word_means(spark, sf_dir))
    return projection_neighbours(points, SENTENCE_POINTS)


def q_sentence_signatures(spark, sf_dir):
    """Signatures of all sentences, those without a known word among them."""
    points = projection_input(word_means(spark, sf_dir))
    return projection_signatures(points, ALL_POINTS).withColumn(
        "sig", signature_bits(F.col("sig"), ALL_POINTS)
    )


# -- SQL ---------------------------------------------------------------------


def in_sql(spark, sf_dir, statement):
    """A statement over ``documents`` with the library's SQL functions."""
    register(spark, MINHASH)
    return spark.sql(statement, documents=documents(spark, sf_dir))


SENTENCES_IN_SQL = "SELECT doc_id, s.ord, s.sentence FROM {documents}, LATERAL document_sentences(text) s"
TOKENS_IN_SQL = f"SELECT doc_id, ord, array_join(clean_token_list(sentence), ' ') AS tokens FROM ({SENTENCES_IN_SQL})"
MINHASH_IN_SQL = f"""
SELECT doc_id, ord, t.fn, t.value
FROM (SELECT doc_id, ord, prime_minhash(sentence) AS mh FROM ({SENTENCES_IN_SQL})
      WHERE length(sentence) - {MINHASH.shingle_len - 1} > {MINHASH.min_shingles}
        AND length(sentence) - {MINHASH.shingle_len - 1} < {MINHASH.max_shingles}),
LATERAL (SELECT pos AS fn, col AS value FROM posexplode(mh)) t"""


# -- text formats ------------------------------------------------------------


def q_article_text_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "articles")
    files.write_articles(documents(spark, sf_dir), path)
    return files.read_articles(spark, path)


def q_sentence_table_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "sentence_table")
    rows = all_sentences(spark, sf_dir)
    files.write_sentence_table(
        rows.select("doc_id", F.col("ord").alias("page_id"), F.col("sentence").alias("text")), path
    )
    return files.read_sentence_table(spark, path)


def q_vector_csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "vectors")
    rows = embeddings(spark, sf_dir).select(F.col("id").alias("doc_id"), F.lit(0).alias("ord"), "vec")
    files.write_vectors(rows, path)
    read = files.read_vectors(spark, path, EMBEDDINGS.vec_len)
    return read.withColumn("vec", micros(F.col("vec")))


def q_bucket_text_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "buckets")
    files.write_buckets(BucketJob(documents(spark, sf_dir), MINHASH).member_sentences(), path)
    return files.read_buckets(spark, path)


def q_edge_text_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "edges")
    files.write_edges(q_star_edges(spark, sf_dir), path)
    return files.read_edges(spark, path)


def q_pair_text_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "pairs")
    files.write_pairs(q_rp_neighbours(spark, sf_dir), path)
    return files.read_pairs(spark, path)


def q_cluster_text_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "clusters")
    files.write_clusters(q_neighbour_clusters(spark, sf_dir), path)
    return files.read_clusters(spark, path)


def q_faulty_lines(spark, sf_dir):
    """Vector lines with article lines among them: how many rows, and how many faults of which kind."""
    path = fresh_path(spark, "mixed_lines")
    rows = embeddings(spark, sf_dir).select(F.col("id").alias("doc_id"), F.lit(0).alias("ord"), "vec")
    files.write_vectors(rows, f"{path}/vectors")
    files.write_articles(documents(spark, sf_dir), f"{path}/articles")
    found = set_aside(spark, f"{path}/*", files.vector_lines(EMBEDDINGS.vec_len))
    kinds = found.rows.select(F.lit("none").alias("reason")).unionAll(found.rejected.select("reason"))
    return kinds.groupBy("reason").agg(F.count("*").alias("n")).select(
        "reason", "n", F.lit(found.n_rows).cast("bigint").alias("n_rows"), F.lit(found.n_rejected).cast("bigint").alias("n_rejected")
    )


# -- whole jobs, files to files ----------------------------------------------


def bucket_lines(spark, sf_dir):
    articles, buckets = fresh_path(spark, "articles"), fresh_path(spark, "buckets")
    files.write_articles(documents(spark, sf_dir), articles)
    jobs.minhash_job(spark, articles, buckets, MINHASH, partitions=4)
    return buckets


def q_minhash_file_job(spark, sf_dir):
    return files.read_buckets(spark, bucket_lines(spark, sf_dir))


def q_bucket_cluster_file_job(spark, sf_dir):
    path = fresh_path(spark, "clusters")
    jobs.cluster_job(spark, bucket_lines(spark, sf_dir), path, "buckets", 4, group_rows=HOT_ROWS)
    return files.read_clusters(spark, path)


def pair_lines(spark, sf_dir):
    vectors, pairs = fresh_path(spark, "vectors"), fresh_path(spark, "pairs")
    rows = embeddings(spark, sf_dir).select(F.col("id").alias("doc_id"), F.lit(0).alias("ord"), "vec")
    opposite = F.transform("vec", lambda v: -v)
    files.write_vectors(rows.withColumn("vec", opposite), vectors)
    files.write_vectors(rows, vectors)  # replaces what is there
    jobs.projection_job(spark, vectors, pairs, EMBEDDINGS, partitions=4)
    return pairs


def q_projection_file_job(spark, sf_dir):
    return files.read_pairs(spark, pair_lines(spark, sf_dir))


def q_pair_cluster_file_job(spark, sf_dir):
    path = fresh_path(spark, "clusters")
    jobs.cluster_job(spark, pair_lines(spark, sf_dir), path, "pairs", 4)
    return files.read_clusters(spark, path)


def q_sentence_vector_file_job(spark, sf_dir):
    table, words, vectors = (fresh_path(spark, name) for name in ("table", "words", "vectors"))
    rows = all_sentences(spark, sf_dir)
    files.write_sentence_table(
        rows.select("doc_id", F.col("ord").alias("page_id"), F.col("sentence").alias("text")), table
    )
    word_table(rows).write.parquet(words)
    jobs.sentence_vector_job(spark, table, words, vectors, WORD_DIMS, partitions=4)
    return files.read_vectors(spark, vectors, WORD_DIMS).withColumn("vec", micros(F.col("vec")))


def entry(spark: SparkSession) -> DataFrame:
    """Sentences that share a MinHash bucket, with their text."""
    return q_minhash_buckets(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "sentences": all_sentences,
        "sentence_candidates": candidates,
        "shingle_counts": q_shingle_counts,
        "minhash_vectors": q_minhash_vectors,
        "minhash_vectors_prime": partial(q_minhash_vectors, family="prime"),
        "minhash_single_fn": q_minhash_single_fn,
        "minhash_argmin": q_minhash_argmin,
        "minhash_signatures": q_minhash_signatures,
        "minhash_buckets": q_minhash_buckets,
        "minhash_bucket_sizes": q_minhash_bucket_sizes,
        "star_edges": q_star_edges,
        "neighbour_clusters": q_neighbour_clusters,
        "rp_signatures": q_rp_signatures,
        "rp_neighbours": q_rp_neighbours,
        "rp_clusters": q_rp_clusters,
        "clean_tokens": q_clean_tokens,
        "sentence_vectors": q_sentence_vectors,
        "sentence_vector_neighbours": q_sentence_vector_neighbours,
        "article_text_roundtrip": q_article_text_roundtrip,
        "sentence_table_roundtrip": q_sentence_table_roundtrip,
        "vector_csv_roundtrip": q_vector_csv_roundtrip,
        "bucket_text_roundtrip": q_bucket_text_roundtrip,
        "edge_text_roundtrip": q_edge_text_roundtrip,
        "pair_text_roundtrip": q_pair_text_roundtrip,
        "cluster_text_roundtrip": q_cluster_text_roundtrip,
        "minhash_buckets_hot": partial(q_minhash_buckets, group_rows=HOT_ROWS),
        "neighbour_clusters_parts": q_neighbour_clusters_parts,
        "rp_neighbours_cells": partial(q_rp_neighbours, round_rows=ROUND_ROWS, cell_rows=CELL_ROWS),
        "sentence_vectors_large": partial(q_sentence_vectors, broadcast_bytes=SLICE_BYTES),
        "sentence_signatures": q_sentence_signatures,
        "minhash_file_job": q_minhash_file_job,
        "bucket_cluster_file_job": q_bucket_cluster_file_job,
        "projection_file_job": q_projection_file_job,
        "pair_cluster_file_job": q_pair_cluster_file_job,
        "sentence_vector_file_job": q_sentence_vector_file_job,
        "sentences_sql": partial(in_sql, statement=SENTENCES_IN_SQL),
        "clean_tokens_sql": partial(in_sql, statement=TOKENS_IN_SQL),
        "minhash_vectors_sql": partial(in_sql, statement=MINHASH_IN_SQL),
        "minhash_buckets_in_batches": q_minhash_buckets_in_batches,
        "minhash_buckets_in_batches_hot": partial(q_minhash_buckets_in_batches, group_rows=HOT_ROWS),
        "trained_sentence_vectors": q_trained_sentence_vectors,
        "bucket_components": q_bucket_components,
        "rp_components": q_rp_components,
        "verified_pairs": q_verified_pairs,
        "verified_pairs_hot": partial(q_verified_pairs, group_rows=HOT_ROWS, broadcast_rows=0),
        "faulty_lines": q_faulty_lines,
        **(llm.QUERIES if llm else {}),
    }
    return {name: leased(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    p = MINHASH
    embedding_pairs = sql.pairs(EMBEDDINGS, sql.bits(EMBEDDINGS, sql.EMBEDDINGS))
    points = sql.sentence_vectors(WORD_DIMS) + sql.bits(SENTENCE_POINTS, sql.SENTENCE_POINTS)
    every_point = sql.sentence_vectors(WORD_DIMS) + sql.bits(ALL_POINTS, sql.ALL_POINTS)
    buckets = sql.statement(
        sql.members(p),
        "SELECT draw, sig, m.doc_id, m.ord, bucket_size, sentence "
        "FROM members m JOIN candidates c ON m.doc_id = c.doc_id AND m.ord = c.ord",
    )
    clusters_of = sql.statement(sql.edges(p), sql.CLUSTERS)
    vectors = sql.statement(
        sql.sentence_vectors(WORD_DIMS), f"SELECT doc_id, ord, {sql.MICROS} AS vec, n_words FROM sentence_vectors"
    )
    verified = sql.verified(p, 0.8)
    batches = sql.statement(sql.members(p), "SELECT draw, sig, doc_id, ord, bucket_size FROM members")
    file_pairs = sql.pairs(EMBEDDINGS, sql.bits(EMBEDDINGS, sql.WRITTEN_EMBEDDINGS))
    sentence_rows = sql.statement(sql.SENTENCES, "SELECT doc_id, ord, sentence FROM sentences")
    token_rows = sql.statement(sql.tokens(), "SELECT doc_id, ord, array_to_string(tokens, ' ') AS tokens FROM tokens")
    return {
        "sentences": sentence_rows,
        "sentences_sql": sentence_rows,
        "clean_tokens_sql": token_rows,
        "minhash_vectors_sql": sql.prime_values(p),
        "sentence_candidates": sql.statement(
            sql.candidates(p), "SELECT doc_id, ord, sentence FROM candidates"
        ),
        "shingle_counts": sql.statement(
            sql.shingle_rows(p),
            "SELECT doc_id, ord, count(*)::INTEGER AS n_shingles, "
            "count(DISTINCT shingle)::INTEGER AS n_distinct FROM shingles GROUP BY doc_id, ord",
        ),
        "minhash_vectors": sql.minhash_values(p),
        "minhash_vectors_prime": sql.prime_values(p),
        "minhash_single_fn": sql.single_function(p, 3),
        "minhash_argmin": sql.argmin(p),
        "minhash_signatures": sql.statement(
            sql.signatures(p), "SELECT draw, sig, doc_id, ord FROM signatures"
        ),
        "minhash_buckets": buckets,
        "minhash_buckets_hot": buckets,
        "minhash_bucket_sizes": sql.statement(
            sql.members(p), "SELECT draw, sig, bucket_size FROM buckets"
        ),
        "star_edges": sql.statement(sql.edges(p), "SELECT src, dst FROM edges"),
        "neighbour_clusters": clusters_of,
        "cluster_text_roundtrip": clusters_of,
        "neighbour_clusters_parts": f"SELECT node, size, members FROM ({clusters_of})",
        "rp_signatures": sql.statement(
            sql.bits(EMBEDDINGS, sql.EMBEDDINGS), f"SELECT perm, id, {sql.sign_text(EMBEDDINGS)} AS sig FROM bits"
        ),
        "rp_neighbours": sql.statement(embedding_pairs, sql.PAIRS),
        "rp_neighbours_cells": sql.statement(embedding_pairs, sql.PAIRS),
        "rp_clusters": sql.statement(embedding_pairs + sql.PAIR_EDGES, sql.CLUSTERS),
        "clean_tokens": token_rows,
        "sentence_vectors": vectors,
        "sentence_vectors_large": vectors,
        "sentence_signatures": sql.statement(
            every_point, f"SELECT perm, id, {sql.sign_text(ALL_POINTS)} AS sig FROM bits"
        ),
        "sentence_vector_neighbours": sql.statement(sql.pairs(SENTENCE_POINTS, points), sql.PAIRS),
        "article_text_roundtrip": r"SELECT doc_id::VARCHAR AS doc_id, "
        r"regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM documents",
        "sentence_table_roundtrip": sql.statement(
            sql.SENTENCES,
            r"SELECT doc_id, ord::BIGINT AS page_id, "
            r"regexp_replace(sentence, '[\t\r\n]+', ' ', 'g') AS text FROM sentences",
        ),
        "vector_csv_roundtrip": sql.statement(
            [sql.EMBEDDINGS, sql.WRITTEN], f"SELECT id || ':0' AS id, {sql.MICROS} AS vec FROM written"
        ),
        "bucket_text_roundtrip": sql.statement(
            sql.members(p),
            "SELECT rtrim(sig, ']') AS sig, doc_id::VARCHAR AS doc_id, ord FROM members",
        ),
        "edge_text_roundtrip": sql.statement(sql.edges(p), "SELECT src, dst FROM edges"),
        "minhash_file_job": sql.on_articles(
            sql.statement(
                sql.members(p),
                "SELECT rtrim(sig, ']') AS sig, doc_id::VARCHAR AS doc_id, ord FROM members",
            )
        ),
        "bucket_cluster_file_job": sql.on_articles(
            sql.statement(sql.members(p) + sql.LINE_EDGES, sql.CLUSTERS)
        ),
        "projection_file_job": sql.statement(file_pairs, "SELECT dist, id_a, id_b FROM pairs"),
        "pair_cluster_file_job": sql.statement(file_pairs + sql.PAIR_EDGES, sql.CLUSTERS),
        "sentence_vector_file_job": sql.statement(
            sql.sentence_vectors(WORD_DIMS) + [sql.WRITTEN_SENTENCES], f"SELECT id, {sql.MICROS} AS vec FROM written"
        ),
        "pair_text_roundtrip": sql.statement(
            embedding_pairs,
            "SELECT dist, id_a::VARCHAR AS id_a, id_b::VARCHAR AS id_b FROM pairs",
        ),
        "minhash_buckets_in_batches": batches,
        "minhash_buckets_in_batches_hot": batches,
        "bucket_components": sql.statement(sql.edges(p) + sql.REACH, sql.COMPONENTS),
        "rp_components": sql.statement(embedding_pairs + sql.PAIR_EDGES + sql.REACH, sql.COMPONENTS),
        "verified_pairs": verified,
        "verified_pairs_hot": verified,
        "faulty_lines": sql.FAULTY_LINES,
        **(llm.ORACLE_SQL if llm else {}),
    }
