"""DuckDB statements that compute the registered queries independently.

Nothing here shares code with the Spark side beyond the fixed values: seeds'
coefficients, draw indices, hyperplanes, stop words. Every statement reads the
whole tables.
"""

from __future__ import annotations

from likeness.functions.hashing import (
    PRIME,
    MultiplyShiftFamily,
    PrimeFamily,
    draw_indices,
)
from likeness.functions.text import SPLIT_WORDS, STOP_WORDS, URL_PATTERN, USER_PATTERN
from likeness.operators.projection import coordinate_orders, hyperplanes
from likeness.params import MinHashParams, ProjectionParams

MASK = (1 << 64) - 1


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def statement(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# -- sentences ---------------------------------------------------------------

SENTENCES = [
    r"""parts AS (
  SELECT doc_id, string_split(
    regexp_replace(text, '([.!?][''"]?)\s+', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM documents)""",
    """segments AS (
  SELECT doc_id, unnest(parts) AS seg, generate_subscripts(parts, 1) AS p FROM parts)""",
    """sentences AS (
  SELECT doc_id,
         (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS ord,
         regexp_extract(seg, '(?s)[A-Z"].*', 0) AS sentence
  FROM segments WHERE regexp_matches(seg, '[A-Z"]'))""",
]


def candidates(p: MinHashParams) -> list[str]:
    n = f"length(sentence) - {p.shingle_len - 1}"
    return SENTENCES + [
        f"""candidates AS (
  SELECT doc_id, ord, sentence, {n} AS n FROM sentences
  WHERE {n} > {p.min_shingles} AND {n} < {p.max_shingles})"""
    ]


def shingle_rows(p: MinHashParams) -> list[str]:
    return candidates(p) + [
        """positions AS (
  SELECT doc_id, ord, sentence, n, unnest(range(1, n + 1)) AS i FROM candidates)""",
        f"""shingles AS (
  SELECT doc_id, ord, i, substr(sentence, i, {p.shingle_len}) AS shingle FROM positions)""",
    ]


# -- MinHash -----------------------------------------------------------------


def word_rows(p: MinHashParams) -> list[str]:
    """One row per shingle with its packed words ``w0, w1, ...``."""
    if p.shingle_len % 3:
        raise ValueError("written for whole words of three characters")
    over = "OVER (PARTITION BY doc_id, ord ORDER BY i)"
    words = ", ".join(
        f"lead(tri, {3 * w}) {over} AS w{w}" if w else "tri AS w0"
        for w in range(p.shingle_len // 3)
    )
    return candidates(p) + [
        """points AS (
  SELECT doc_id, ord, n, unnest(range(1, length(sentence) + 1)) AS i,
         unnest(string_split(sentence, '')) AS c
  FROM candidates)""",
        f"""triples AS (
  SELECT doc_id, ord, n, i,
         unicode(c)::BIGINT
         + (lead(unicode(c), 1) {over})::BIGINT * {1 << 21}
         + (lead(unicode(c), 2) {over})::BIGINT * {1 << 42} AS tri
  FROM points)""",
        f"""words AS (
  SELECT * FROM (SELECT doc_id, ord, n, i, {words} FROM triples) WHERE i <= n)""",
    ]


def multiply_shift(p: MinHashParams, fn: int) -> str:
    family = MultiplyShiftFamily(p)
    terms = " + ".join(
        f"((w{w}::HUGEINT * {int(a)}::HUGEINT) & {MASK}::HUGEINT)"
        for w, a in enumerate(family.a[fn])
    )
    total = f"({terms} + {int(family.b[fn])}::HUGEINT) & {MASK}::HUGEINT"
    return f"(({total}) >> {64 - p.hash_bits})"


def vectors(p: MinHashParams) -> list[str]:
    minima = ", ".join(f"min({multiply_shift(p, j)})::BIGINT" for j in range(p.num_hashes))
    return word_rows(p) + [
        f"vectors AS (SELECT doc_id, ord, [{minima}] AS mh FROM words GROUP BY doc_id, ord)"
    ]


def prime_vectors(p: MinHashParams) -> list[str]:
    family = PrimeFamily(p)
    minima = ", ".join(f"min((base * {a} + {b}) % {PRIME})" for a, b in zip(family.a, family.b))
    return shingle_rows(p) + [
        f"""bases AS (
  SELECT doc_id, ord, ('0x' || substr(md5(shingle), 1, 8))::BIGINT % {PRIME} AS base
  FROM shingles)""",
        f"vectors AS (SELECT doc_id, ord, [{minima}] AS mh FROM bases GROUP BY doc_id, ord)",
    ]


VALUES_LONG = """SELECT doc_id, ord, (i - 1)::INTEGER AS fn, mh[i] AS value
FROM (SELECT doc_id, ord, mh, unnest(range(1, len(mh) + 1)) AS i FROM vectors)"""


def minhash_values(p: MinHashParams) -> str:
    return statement(vectors(p), VALUES_LONG)


def prime_values(p: MinHashParams) -> str:
    return statement(prime_vectors(p), VALUES_LONG)


def single_function(p: MinHashParams, fn: int) -> str:
    return statement(
        word_rows(p),
        f"SELECT doc_id, ord, min({multiply_shift(p, fn)})::BIGINT AS value "
        "FROM words GROUP BY doc_id, ord",
    )


def argmin(p: MinHashParams) -> str:
    # Hash and position in one number: its minimum is the first arg-min.
    firsts = ", ".join(
        f"(min({multiply_shift(p, j)} * 1024 + i) % 1024)::INTEGER" for j in range(p.num_hashes)
    )
    return statement(
        word_rows(p)
        + [f"firsts AS (SELECT doc_id, ord, [{firsts}] AS places FROM words GROUP BY doc_id, ord)"],
        f"""SELECT doc_id, ord, (j - 1)::INTEGER AS fn, substr(sentence, places[j], {p.shingle_len}) AS shingle
FROM (SELECT doc_id, ord, places, unnest(range(1, len(places) + 1)) AS j FROM firsts)
JOIN candidates USING (doc_id, ord)""",
    )


def signatures(p: MinHashParams) -> list[str]:
    draws = ", ".join(
        "'[' || concat_ws(', ', " + ", ".join(f"mh[{i + 1}]" for i in indices) + ") || ']'"
        for indices in draw_indices(p)
    )
    return vectors(p) + [
        f"""signatures AS (
  SELECT (d - 1)::INTEGER AS draw, sigs[d] AS sig, doc_id, ord
  FROM (SELECT doc_id, ord, sigs, unnest(range(1, {p.draws + 1})) AS d
        FROM (SELECT doc_id, ord, [{draws}] AS sigs FROM vectors)))"""
    ]


def members(p: MinHashParams) -> list[str]:
    return signatures(p) + [
        """buckets AS (
  SELECT draw, sig, count(*) AS bucket_size, min((doc_id, ord)) AS hub
  FROM signatures GROUP BY draw, sig HAVING count(*) > 1)""",
        """members AS (
  SELECT s.draw, s.sig, s.doc_id, s.ord, b.bucket_size, b.hub
  FROM signatures s JOIN buckets b ON s.draw = b.draw AND s.sig = b.sig)""",
    ]


def edges(p: MinHashParams) -> list[str]:
    return members(p) + [
        """spokes AS (
  SELECT DISTINCT hub[1] || ':' || hub[2] AS src, doc_id || ':' || ord AS dst
  FROM members WHERE hub <> (doc_id, ord))""",
        """edges AS (SELECT src, dst FROM spokes UNION SELECT dst, src FROM spokes)""",
    ]


CLUSTERS = """SELECT src AS node, (count(DISTINCT dst) + 1)::BIGINT AS size, 0 AS part,
       1 AS parts, array_to_string(list_sort(list_append(list(DISTINCT dst), src)), ', ') AS members
FROM edges GROUP BY src"""


REACH = [
    """reach AS (
  SELECT src AS node, dst AS other FROM edges
  UNION SELECT node, dst FROM reach JOIN edges ON other = src)"""
]
COMPONENTS = "SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node"


def verified(p: MinHashParams, threshold: float) -> str:
    return statement(
        members(p)
        + [
            """pairs AS (
  SELECT DISTINCT hub[1] AS hub_doc, hub[2] AS hub_ord, doc_id, ord FROM members WHERE hub <> (doc_id, ord))""",
            f"""sets AS (
  SELECT doc_id, ord, list_distinct(list_transform(range(1, n + 1),
      lambda i: substr(sentence, i, {p.shingle_len}))) AS s FROM candidates)""",
            """counted AS (
  SELECT hub_doc || ':' || hub_ord AS src, a.doc_id || ':' || a.ord AS dst,
         len(list_intersect(a.s, b.s))::INTEGER AS shared, (len(a.s) + len(b.s))::INTEGER AS summed
  FROM pairs JOIN sets a ON a.doc_id = pairs.doc_id AND a.ord = pairs.ord
  JOIN sets b ON b.doc_id = hub_doc AND b.ord = hub_ord)""",
        ],
        "SELECT src, dst, shared, summed - shared AS total, shared::DOUBLE / (summed - shared) AS jaccard "
        f"FROM counted WHERE shared::DOUBLE / (summed - shared) >= {threshold}",
    )


FAULTY_LINES = r"""WITH lines AS (
  SELECT string_split(doc_id || ', ' || regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), ',') AS fields
  FROM documents
), kinds AS (
  SELECT CASE WHEN len(fields) < 66 THEN 'fewer than 64 values'
      WHEN len(list_filter(fields[1:2], lambda x: try_cast(x AS DECIMAL(38,10)) IS NULL)) > 0 THEN 'an id is not a number'
      ELSE 'a value is not a number' END AS reason FROM lines
  UNION ALL SELECT 'none' FROM embeddings
)
SELECT reason, count(*) AS n, (SELECT count(*) FROM embeddings) AS n_rows, (SELECT count(*) FROM documents) AS n_rejected
FROM kinds GROUP BY reason"""


# -- random projection -------------------------------------------------------


WORD_BITS = 60


def sign_words(p: ProjectionParams) -> list[tuple[str, int]]:
    """Names and widths of the whole numbers that hold a signature's bits."""
    return [(f"w{n}", min(WORD_BITS, p.sig_len - i)) for n, i in enumerate(range(0, p.sig_len, WORD_BITS))]


def bits(p: ProjectionParams, vectors_cte: str) -> list[str]:
    """``bits(perm, id, w0, w1, ...)`` from ``v(id, vec DOUBLE[])``; equal vectors are multiplied once."""
    planes = [[float(x) for x in plane] for plane in hyperplanes(p)]
    orders = ", ".join(
        f"({j}, {[int(x) + 1 for x in order]})" for j, order in enumerate(coordinate_orders(p))
    )
    words, done = [], 0
    for name, width in sign_words(p):
        sign = (
            f"((list_dot_product(vec, {plane}::DOUBLE[]) >= 0)::BIGINT << {width - 1 - i})"
            for i, plane in enumerate(planes[done : done + width])
        )
        words.append(f"{' | '.join(sign)} AS {name}")
        done += width
    return [
        vectors_cte,
        "different AS (SELECT vec, list(id) AS ids FROM v GROUP BY vec)",
        f"orders(perm, places) AS (VALUES {orders})",
        "reordered AS (SELECT perm, ids, list_select(vec, places) AS vec FROM different, orders)",
        f"bits AS MATERIALIZED (SELECT perm::INTEGER AS perm, unnest(ids) AS id, {', '.join(words)} FROM reordered)",
    ]


def sign_text(p: ProjectionParams) -> str:
    return " || ".join(f"lpad(bin({name}), {width}, '0')" for name, width in sign_words(p))


def pairs(p: ProjectionParams, bit_ctes: list[str]) -> list[str]:
    names = [name for name, _ in sign_words(p)]
    words = ", ".join(names)
    dist = " + ".join(f"bit_count(xor(a.{w}, b.{w}))" for w in names)
    return bit_ctes + [
        f"""ranked AS (
  SELECT perm, id, {words}, row_number() OVER (PARTITION BY perm ORDER BY {words}, id) AS r FROM bits)""",
        f"""looking AS (
  SELECT perm, id, {words}, r - unnest(range(1, {p.window + 1})) AS r FROM ranked)""",
        f"""pairs AS (
  SELECT a.perm, ({dist})::INTEGER AS dist, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b
  FROM looking a JOIN ranked b ON a.perm = b.perm AND a.r = b.r
  WHERE {dist} < {p.threshold})""",
    ]


EMBEDDINGS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
# Text files carry ten decimals.
WRITTEN = """written AS (
  SELECT id, list_transform(vec, lambda x: printf('%.10f', x)::DOUBLE) AS vec FROM v)"""
WRITTEN_EMBEDDINGS = """v AS (
  SELECT vec_id || ':0' AS id, list_transform(embedding, lambda x: printf('%.10f', x::DOUBLE)::DOUBLE) AS vec
  FROM embeddings)"""
PAIRS = "SELECT perm, dist, id_a, id_b FROM pairs"
PAIR_EDGES = [
    """edges AS (
  SELECT id_a::VARCHAR AS src, id_b::VARCHAR AS dst FROM pairs
  UNION SELECT id_b::VARCHAR, id_a::VARCHAR FROM pairs)"""
]


# A bucket line knows its signature and not its draw; ids in files are text.
LINE_EDGES = [
    """lines AS (SELECT DISTINCT sig, doc_id::VARCHAR AS doc_id, ord FROM members)""",
    """line_hubs AS (SELECT sig, min((doc_id, ord)) AS hub FROM lines GROUP BY sig)""",
    """spokes AS (
  SELECT DISTINCT hub[1] || ':' || hub[2] AS src, doc_id || ':' || ord AS dst
  FROM lines JOIN line_hubs USING (sig) WHERE hub <> (doc_id, ord))""",
    """edges AS (SELECT src, dst FROM spokes UNION SELECT dst, src FROM spokes)""",
]


def on_articles(sql: str) -> str:
    """The statement over documents as article lines hold them."""
    lines = r"(SELECT doc_id, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM documents)"
    return sql.replace("FROM documents", f"FROM {lines}")


# -- tokens and sentence vectors ---------------------------------------------


def tokens() -> list[str]:
    text = "sentence"
    for pattern, mask in ((URL_PATTERN, "URL"), (USER_PATTERN, "AT_USER")):
        text = f"regexp_replace({text}, {literal(pattern)}, '{mask}', 'g')"
    text = f"lower(regexp_replace({text}, '[^a-zA-Z]+', ' ', 'g'))"
    for words in SPLIT_WORDS:
        text = rf"regexp_replace({text}, '\b{words.replace(' ', '')}\b', '{words}', 'g')"
    stop = ", ".join(literal(w) for w in STOP_WORDS)
    return SENTENCES + [
        f"""tokens AS (
  SELECT doc_id, ord,
         list_filter(string_split({text}, ' '), lambda t: t <> '' AND t NOT IN ({stop})) AS tokens
  FROM sentences)"""
    ]


HALF_PRIME = PRIME / 2


def word_coefficients(dims: int) -> list[tuple[int, int]]:
    """Constants that spread a word's hash over its vector."""
    return [(1000003 * (i + 1), 7919 * (i + 1)) for i in range(dims)]


def sentence_vectors(dims: int) -> list[str]:
    values = ", ".join(
        f"(((base * {a} + {b}) % {PRIME}) / {HALF_PRIME}::DOUBLE - 1)::FLOAT::DOUBLE AS v{i}"
        for i, (a, b) in enumerate(word_coefficients(dims))
    )
    sums = ", ".join(f"avg(v{i}) AS v{i}" for i in range(dims))
    means = ", ".join(f"coalesce(v{i}, 0.0::DOUBLE)" for i in range(dims))
    return tokens() + [
        """texts AS MATERIALIZED (
  SELECT tokens, list({'doc_id': doc_id, 'ord': ord}) AS places, row_number() OVER () AS text
  FROM tokens GROUP BY tokens)""",
        "token_rows AS (SELECT text, unnest(tokens) AS word FROM texts)",
        f"""vocabulary AS (
  SELECT word, {values}
  FROM (SELECT DISTINCT word, ('0x' || substr(md5(word), 1, 8))::BIGINT AS base
        FROM token_rows WHERE substr(md5(word), 1, 1) <> 'f'))""",
        f"means AS (SELECT text, {sums}, count(*) AS n FROM token_rows JOIN vocabulary USING (word) GROUP BY text)",
        f"""sentence_vectors AS (
  SELECT p.doc_id AS doc_id, p.ord AS ord, vec, n_words
  FROM (SELECT unnest(places) AS p, [{means}] AS vec, coalesce(n, 0)::BIGINT AS n_words
        FROM texts LEFT JOIN means USING (text)))""",
    ]


MICROS = "array_to_string(list_transform(vec, lambda x: round(x * 1000000)::BIGINT), ',')"
SENTENCE_POINTS = """v AS (
  SELECT doc_id || ':' || ord AS id, vec FROM sentence_vectors
  WHERE len(list_filter(vec, lambda x: x <> 0)) > 0)"""
ALL_POINTS = "v AS (SELECT doc_id || ':' || ord AS id, vec FROM sentence_vectors)"
WRITTEN_SENTENCES = """written AS (
  SELECT doc_id || ':' || ord AS id, list_transform(vec, lambda x: printf('%.10f', x)::DOUBLE) AS vec
  FROM sentence_vectors)"""
