"""Personal data by fixed patterns, and by contexts that such data shares.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.sizes import small
from likeness.plans.staging import stage

# The four kinds, in order, with their patterns. Runs are taken
# whole, and a search starts only where the first match could: the same matches
# as with the plain patterns, without trying each character of a long run and
# without a stack that grows with it.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without these holds no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
BYTE = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Kinds beyond the four begin with values that their form alone gives away:
# keys of 40 or 64 hexadecimal digits, letters and numbers among them.
SEEDS = {"secret": r"^(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"}
ORDER = [*KINDS, *SEEDS]

# What an identifier may look like: six or more characters, a digit among them.
CANDIDATE = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z@._+-]*+[0-9])[A-Za-z0-9@._+-]{6,}+"
ROUNDS = 3
# A pattern counts if the share of known identifiers among all that follow it
# is at least this, by the lower end of its uncertainty (one standard error):
# two of two, five of six, fifteen of twenty. An instance needs this score.
MIN_CONFIDENCE = 0.6
MIN_SCORE = 0.8

_PLACE = "struct<start:bigint,end:bigint,value:string,left:string>"
WHITE = r"[\x20\x09-\x0D]+"


def last_words(text: Column) -> Column:
    """The last two words and what follows the blank behind them."""
    return F.substring_index(text, " ", -3)


def located(text: Column, pattern: str, need: str = "") -> Column:
    """All matches with code-point offsets and the two words before them.

    Between the matches lie the pieces that ``split`` gives; adding up both
    gives the places. The last words of all that was passed go along, matches
    and all, so a place has the same words before it whatever else matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.lit("").alias("passed"), F.array().cast(f"array<{_PLACE}>").alias("found")
    )

    def step(done, piece):
        begin = done["at"] + F.char_length(piece["gap"])
        end = begin + F.char_length(piece["match"])
        left = last_words(F.concat(done["passed"], F.regexp_replace(piece["gap"], WHITE, " ")))
        place = F.struct(
            begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), piece["match"].alias("value"), left.alias("left")
        )
        passed = last_words(F.concat(left, F.regexp_replace(piece["match"], WHITE, " ")))
        return F.when(piece["match"].isNull(), done).otherwise(
            F.struct(end.cast("bigint").alias("at"), passed.alias("passed"), F.concat(done["found"], F.array(place)).alias("found"))
        )

    some = text.rlike(pattern)
    if need:
        some = F.contains(text, F.lit(need)) & some
    none = F.array().cast(f"array<{_PLACE}>")
    return F.when(some, F.aggregate(pieces, start, step, lambda done: done["found"])).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    places = F.sequence(F.lit(1), F.char_length(number))
    digit = F.transform(places, lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int"))
    doubled = F.transform(digit, lambda d, i: F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(BYTE)
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    return F.lit(True)


def _tagged(kind: str | None, places: Column) -> Column:
    order = len(ORDER) if kind is None else ORDER.index(kind)
    return F.transform(
        places,
        lambda p: F.struct(
            p["start"].alias("start"),
            F.lit(order).alias("order"),
            p["end"].alias("end"),
            F.lit(kind).cast("string").alias("kind"),
            p["value"].alias("value"),
            p["left"].alias("left"),
            (F.lit(True) if kind is None else valid(kind, p["value"])).alias("ok"),
        ),
    )


def shape(value: Column) -> Column:
    """Which kinds of characters a value has, and how many in all."""
    marks = [F.when(value.rlike(f"[{of}]"), F.lit(sign)).otherwise("") for of, sign in (("a-z", "a"), ("A-Z", "A"), ("0-9", "0"))]
    other = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(value, "[A-Za-z0-9]", ""), ""))), "")
    return F.concat(*marks, other, F.lit(":"), F.char_length(value).cast("string"))


def patterns(left: Column, value: Column) -> Column:
    """The lexical patterns of a place, case and digits folded.

    The two words before it, and the one word before it with its shape; none
    without a word.
    """
    folded = F.regexp_replace(F.lower(left), "[0-9]", "0")
    one = F.substring_index(folded, " ", -2)
    return F.filter(
        F.array(
            F.when(F.trim(folded) != "", F.concat(F.lit("2 "), folded)),
            F.when(F.trim(one) != "", F.concat(F.lit("1 "), one, F.lit(" "), shape(value))),
        ),
        lambda p: p.isNotNull(),
    )


def _lower_end(share: Column, n: Column) -> Column:
    """Wilson's lower limit of a share of ``n``, one standard error wide."""
    spread = F.sqrt(share * (1 - share) / n + 1 / (4 * n * n))
    return (share + 1 / (2 * n) - spread) / (1 + 1 / n)


def grow(known: DataFrame, pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(instance, kind, score)`` of all that is known in the end, seeds with score 1.

    ``pairs(pattern, instance)`` are distinct, ``known(instance, kind)`` the
    seeds; of several kinds of a seed the first by name counts. In each round a
    pattern's share is the mean score of its instances, its confidence the
    lower end of that share's uncertainty; it counts from ``MIN_CONFIDENCE`` on,
    for the kind of most weight (of equal ones the first by name). An instance
    that is no seed then scores 1 - prod(1 - confidence) over its patterns and
    has the kind of the most confident one (of equal ones the first by name);
    those of ``MIN_SCORE`` or more are known in the next round. Aggregations
    and joins on keys only; each round is written.
    """
    seeds = stage(known.groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)), "known")
    scored = seeds
    for _ in range(rounds):
        weights = (
            pairs.join(scored, "instance", "left")
            .groupBy("pattern", "kind")
            .agg(F.count("*").alias("n"), F.sum("score").alias("weight"))
        )
        total = F.sum("n")
        share = F.coalesce(F.sum("weight"), F.lit(0.0)) / total
        best = F.min(F.when(F.col("kind").isNotNull(), F.struct((-F.col("weight")).alias("w"), "kind")))
        confident = stage(
            weights.groupBy("pattern")
            .agg(_lower_end(share, total).alias("confidence"), best["kind"].alias("kind"))
            .filter(F.col("confidence") >= MIN_CONFIDENCE),
            "patterns",
        )
        found = (
            pairs.join(small(confident, confident.count()), "pattern")
            .groupBy("instance")
            .agg(
                F.min(F.struct((-F.col("confidence")).alias("c"), "kind"))["kind"].alias("kind"),
                (1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"),
            )
            .filter(F.col("score") >= MIN_SCORE)
            .join(seeds, "instance", "left_anti")
        )
        scored = stage(seeds.unionByName(found), "known")
    return scored


def find(docs: DataFrame, text: str = "text", keep_text: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """Add ``base`` and ``spans`` to every row of ``docs``, sorted by start and kind.

    Both are arrays of ``(start, order, end, kind)``, code points, end
    exclusive. ``base`` has the matches of the four kinds, leftmost and without
    overlap within a kind, if they pass its check. ``spans`` adds values of a
    certain form (``SEEDS``) and identifiers that the graph of patterns and
    instances makes known, wherever they stand; none overlaps a match of the
    four kinds, whether it passed its check or not. Null and empty texts have
    none; every row keeps its row. Columns named ``base`` or ``spans``, or that
    begin with an underscore, are replaced; ``keep_text=False`` leaves the text
    out.

    The text is searched once and written; patterns, instances and their graph
    are distinct pairs found by aggregation, so copies and frequent contexts
    are added up before they meet.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.concat(*(_tagged(kind, located(own, KINDS[kind], NEEDS[kind])) for kind in KINDS))
    marked = docs.withColumns(
        {"_found": F.array_sort(found), "_other": _tagged(None, located(own, CANDIDATE)), "_row": F.monotonically_increasing_id()}
    )
    marked = stage(marked if keep_text else marked.drop(text), "pii_places")
    free = F.filter(
        "_other", lambda o: ~F.exists("_found", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"]))
    )
    places = (
        marked.select("_row", F.explode(F.concat(F.filter("_found", lambda b: b["ok"]), free)).alias("p"))
        .select(
            "_row",
            "p.start",
            "p.end",
            "p.kind",
            F.lower("p.value").alias("instance"),
            patterns(F.col("p.left"), F.col("p.value")).alias("patterns"),
            *(F.col("p.value").rlike(form).alias(f"_{kind}") for kind, form in SEEDS.items()),
        )
    )
    own_kind = F.coalesce("kind", *(F.when(F.col(f"_{kind}"), kind) for kind in SEEDS))
    places = stage(places.select("_row", "start", "end", "kind", "instance", "patterns", own_kind.alias("seed")), "pii_instances")
    pairs = stage(places.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "pii_pairs")
    known = grow(places.filter("seed IS NOT NULL").select("instance", F.col("seed").alias("kind")), pairs, rounds)
    known = known.select("instance", F.col("kind").alias("_kind"))
    orders = F.create_map(*(x for i, k in enumerate(ORDER) for x in (F.lit(k), F.lit(i))))
    more = (
        places.filter("kind IS NULL")
        .join(small(known, known.count()), "instance")
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", F.element_at(orders, F.col("_kind")).alias("order"), "end", F.col("_kind").alias("kind"))).alias("_more"))
    )
    kind = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"
    base = F.transform(F.filter("_found", lambda b: b["ok"]), lambda b: F.struct(b["start"], b["order"], b["end"], b["kind"]))
    return (
        marked.join(more, "_row", "left")
        .withColumn("base", base.cast(kind))
        .withColumn(
            "spans",
            F.array_sort(F.concat("base", F.coalesce(F.col("_more").cast(kind), F.array().cast(kind)))),
        )
        .drop("_row", "_found", "_other", "_more")
    )


def span_list(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The digest form of ``find``: one row per document."""

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans")
    )


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of ``find`` by its kind in square brackets; overlapping spans once."""
    own = F.col(text)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))

    def step(state, span):
        piece = F.substring(own, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        mask = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return (
            F.when(span["end"] <= state["at"], state)
            .when(span["start"] < state["at"], F.struct(span["end"].alias("at"), state["done"].alias("done")))
            .otherwise(F.struct(span["end"].alias("at"), F.concat(state["done"], piece, mask).alias("done")))
        )

    def finish(state):
        return F.concat(state["done"], F.substring(own, (state["at"] + 1).cast("int"), F.char_length(own)))

    cut = F.aggregate("spans", start, step, finish)
    return found.withColumn(text, F.when(F.size("spans") > 0, cut).otherwise(own)).drop("base", "spans")
