"""Queries of the operators over the given tables, and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from likeness.llm import (
    bpe,
    byte_repeats,
    decontaminate,
    packing,
    passages,
    phrases,
    pii,
    quality,
    sharding,
    simhash,
    token_rollup,
    warc,
    whitening,
)
from likeness.plans.staging import fresh_path, stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(
        decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    )


def op2_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select(
        "doc_id", simhash.hex_print(found["print"]).alias("fingerprint"), "component_id"
    )


def op3_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judge(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op5_byte_repeats(spark, sf_dir):
    return byte_repeats.digests(byte_repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, TOKENIZER), TOKENIZER)


def op8_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs, keep_text=False))


JUNK = r"[#*$%&|<>]"


def op9_token_rollup(spark, sf_dir):
    """Totals after all documents came, low-quality ones were cleaned and toxic ones went.

    The last two batches are sent twice, as after a failure.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    # Counted once; what is joined with labels afterwards are counts, not texts.
    counted = stage(
        docs.select(
            "doc_id",
            "source",
            "lang",
            token_rollup.count_tokens(F.col("text")).alias("tokens"),
            token_rollup.count_tokens(F.regexp_replace("text", JUNK, " ")).alias("clean_tokens"),
        ),
        "token_counts",
    )

    def changes(rows, sign, tokens="tokens"):
        return rows.select("source", "lang", F.col(tokens).alias("tokens"), F.lit(sign).alias("sign"))

    def labelled(condition):
        return counted.join(labels.filter(condition).select("doc_id").distinct(), "doc_id", "left_semi")

    poor, toxic = labelled("quality = 0 AND toxic = 0"), labelled("toxic = 1")
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "rollup"))
    rollup.apply("documents", changes(counted, 1))
    for _ in range(2):
        rollup.apply("cleaned", changes(poor, -1).unionByName(changes(poor, 1, "clean_tokens")))
        rollup.apply("toxic", changes(toxic, -1))
        rollup.compact()
    return rollup.totals()


def op10_passages(spark, sf_dir):
    return passages.digests(passages.remove_repeats(table(spark, sf_dir, "documents")))


def op11_whitening(spark, sf_dir):
    return whitening.digests(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.digests(docs, TOKENIZER)


def op13_phrases(spark, sf_dir):
    return phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_byte_repeats": op5_byte_repeats,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_token_rollup": op9_token_rollup,
    "op10_passages": op10_passages,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}

DECONTAMINATE_SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
    FROM item_words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0
), doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
    SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM doc_words, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) WHERE len(w) >= size
), hits AS (
    SELECT d.doc_id, d.i, d.size, p.item_id FROM doc_windows d JOIN item_windows p ON d.size = p.size AND d.win = p.win
), hit_words AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

WARC_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

ROLLUP_SQL = r"""
WITH l AS (SELECT DISTINCT doc_id, quality, toxic FROM labels),
d AS (
    SELECT source, lang, coalesce(CASE
        WHEN doc_id IN (SELECT doc_id FROM l WHERE quality = 0 AND toxic = 0)
        THEN regexp_replace(text, '[#*$%&|<>]', ' ', 'g') ELSE text END, '') AS text
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE toxic = 1)
), c AS (
    SELECT source, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS a,
        len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~]')) AS b
    FROM d
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, sum(a)::BIGINT AS n_tokens FROM c GROUP BY ALL
UNION ALL
SELECT source, lang, 'words-2' AS tokenizer, count(*) AS n_docs, sum(b)::BIGINT AS n_tokens FROM c GROUP BY ALL
"""

PASSAGES_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win
    FROM w, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i) WHERE len(w) >= 20
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM win)
    WHERE r > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later
), words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

PHRASES_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, w FROM (
        SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
        FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
    ) WHERE len(w) > 0
), words AS (
    SELECT piece, lang, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM pieces
), counts AS (SELECT lang, word, count(*) AS f FROM words GROUP BY lang, word),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM counts GROUP BY lang),
known AS MATERIALIZED (SELECT lang, word, f, row_number() OVER () AS id FROM counts WHERE f >= 30),
places AS (
    SELECT lang, id AS a, lead(id) OVER w AS b, lead(id, 2) OVER w AS c, lead(id, 3) OVER w AS d
    FROM words LEFT JOIN known USING (lang, word) WINDOW w AS (PARTITION BY piece ORDER BY place)
), phrases AS MATERIALIZED (
    SELECT lang, [a, b] AS p, count(*) AS f FROM places WHERE a + b > 0 GROUP BY lang, a, b HAVING f >= 30
    UNION ALL
    SELECT lang, [a, b, c], count(*) AS f FROM places WHERE a + b + c > 0 GROUP BY lang, a, b, c HAVING f >= 30
    UNION ALL
    SELECT lang, [a, b, c, d], count(*) AS f FROM places WHERE a + b + c + d > 0 GROUP BY lang, a, b, c, d HAVING f >= 30
), parts AS (SELECT p, f FROM phrases UNION ALL SELECT [id], f FROM known),
cuts AS (SELECT lang, p AS whole, f AS a, unnest(range(1, len(p))) AS k FROM phrases),
scored AS (
    SELECT lang, whole, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
    FROM cuts JOIN parts x ON x.p = whole[1:k] JOIN parts y ON y.p = whole[k + 1:]
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY whole ORDER BY score, k) = 1),
inner_parts AS (
    SELECT p[s:s + m - 1] AS whole, max(f) AS longest FROM phrases, (SELECT unnest([2, 3]) AS m),
        LATERAL (SELECT unnest(range(1, len(p) - m + 2)) AS s) WHERE len(p) > m GROUP BY ALL
), kept AS (
    SELECT best.* FROM best LEFT JOIN inner_parts USING (whole) WHERE longest IS NULL OR 100 * longest < 80 * a
), spelled AS (
    SELECT whole, string_agg(word, ' ' ORDER BY place) AS phrase
    FROM (SELECT whole, unnest(whole) AS id, generate_subscripts(whole, 1) AS place FROM kept) JOIN known USING (id)
    GROUP BY whole
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM kept JOIN spelled USING (whole)
) JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {
    "op1_decontaminate": DECONTAMINATE_SQL,
    "op6_warc": WARC_SQL,
    "op9_token_rollup": ROLLUP_SQL,
    "op10_passages": PASSAGES_SQL,
    "op13_phrases": PHRASES_SQL,
}
