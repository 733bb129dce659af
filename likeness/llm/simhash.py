"""SimHash near duplicates by a generalised pigeonhole search."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm import simhash_kernel as kernel
from likeness.llm.graph import components
from likeness.llm.sizes import matched, small
from likeness.plans.staging import shuffle_tasks, stage

BITS = kernel.BITS
SHINGLE = 3
SEED = 42
DISTANCE = 3
# Distinct fingerprints under one key that a task compares with each other:
# half a megabyte, some seconds. Larger groups take the way of near_stars.
GROUP_PRINTS = 32_768
# Costs of the plan's two parts, in comparisons: one probe row goes through a
# shuffle and a sort, a candidate costs a comparison of two words.
ROW_COST = 200.0


def fingerprints(
    docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED, into: str = "print"
) -> DataFrame:
    """Add ``print``, the 64-bit fingerprint as a signed long.

    Words are what lies between ASCII white space, A-Z folded. Null texts and
    texts without words have fingerprint 0; fewer words than a shingle are one.
    """

    def batch(texts):
        return kernel.fingerprint_batch(texts, shingle, seed)

    return docs.withColumn(into, F.arrow_udf(batch, "bigint")(F.col(text)))


def hex_print(column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of prints and how often two bits are set together; 4,097 numbers."""
    cells = prints.mapInArrow(kernel.count_bits, "cell bigint, n bigint").groupBy("cell").agg(
        F.sum("n").alias("n")
    )
    found = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in cells.collect():
        found[cell] = n
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def correlation(n: int, both: np.ndarray) -> np.ndarray:
    """Absolute correlation of bits over all prints; constant bits have none."""
    if (both.diagonal() > n).any():
        raise ValueError("a bit cannot be set in more prints than there are")
    share = both.diagonal() / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    scale = np.outer(spread, spread)
    covariance = both / max(n, 1) - np.outer(share, share)
    return np.abs(np.divide(covariance, scale, out=np.zeros_like(covariance), where=scale > 0))


def group_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of like size with correlated bits together.

    Bits that vary together tell little more than one of them; in one part they
    spoil one key and not all. Each part starts with the bit most related to
    the bits left, and takes the bit most related to what it has.
    """
    left = set(range(BITS))
    found = []
    for number in range(parts):
        size = len(left) // (parts - number)
        rest = sorted(left)
        part = [max(rest, key=lambda b: related[b, rest].sum())]
        left.remove(part[0])
        while len(part) < size:
            best = max(sorted(left), key=lambda b: related[b, part].sum())
            part.append(best)
            left.remove(best)
        found.append(sorted(part))
    return found


def distance_share(share: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1, ... bits of a part.

    Two prints differ in a bit set in a share p of them with 2p(1 - p); the
    counts of differing bits come from multiplying these out.
    """
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for p in 2 * share[bits] * (1 - share[bits]):
        shifted = np.concatenate([[0.0], chance[:-1]])
        chance = chance * (1 - p) + shifted * p
    return np.cumsum(chance)


def allocate(costs: np.ndarray, budget: int) -> tuple[float, list[int]]:
    """Thresholds with sum ``budget`` and least cost, by dynamic programming.

    ``costs[i, t + 1]`` is the cost of threshold t in part i; t = -1 leaves the
    part out. If the thresholds sum to distance - parts + 1, a close pair keeps
    to the threshold in at least one part.
    """
    parts, choices = costs.shape
    best = {0: (0.0, [])}
    for number in range(parts):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, taken) in best.items():
            for choice in range(choices):
                at = total + choice - 1
                now = cost + costs[number, choice]
                if at not in step or now < step[at][0]:
                    step[at] = (now, [*taken, choice - 1])
        best = step
    return best[budget]


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost for ``n`` prints.

    Tries one part up to distance + 1 parts. More prints lead to wider parts
    with more flips, as candidates grow with their square and probes do not.
    """
    related = correlation(n, both)
    share = both.diagonal() / max(n, 1)
    best = None
    for parts in range(2, distance + 3):
        groups = group_bits(related, parts)
        costs = np.zeros((parts, distance + 2))
        for number, bits in enumerate(groups):
            near = distance_share(share, bits, distance)
            for t in range(distance + 1):
                probes = sum(math.comb(len(bits), f) / 2**f for f in range(t + 1))
                costs[number, t + 1] = ROW_COST * n * probes + near[t] * n * n / 2
        cost, thresholds = allocate(costs, distance - parts + 1)
        if best is None or cost < best[0]:
            best = (cost, list(zip(groups, thresholds)))
    return best[1]


def close_prints(
    prints: DataFrame,
    parts: list[tuple[list[int], int]],
    distance: int = DISTANCE,
    group_prints: int = GROUP_PRINTS,
) -> DataFrame:
    """Links ``(src, dst)`` that connect all prints within ``distance`` bits.

    ``prints(print)`` are distinct. Probe rows meet under their key; each task
    compares the rows of a key and returns a forest of the links, so a group of
    copies gives one row for each and not one for each pair. Keys with more
    than ``group_prints`` rows are counted first and leave that way: their
    prints meet under codes half way between them, where all that are near
    enough to the code link to one of the nearest. Both ways find every link.
    """
    schema = "part tinyint, key bigint, flips tinyint, print bigint"
    rows = prints.mapInArrow(partial(kernel.probe_rows, parts=parts), schema)
    large = stage(
        rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > group_prints),
        "large_keys",
    )
    allowed = [t for _, t in parts]
    link = partial(kernel.link_batches, allowed=allowed, distance=distance)
    some = not large.isEmpty()
    usual = rows.join(large, ["part", "key"], "left_anti") if some else rows
    probes = sum(math.comb(len(bits), f) for bits, t in parts for f in range(t + 1))
    found = (
        usual.repartition(shuffle_tasks(prints.sparkSession, prints.count() * probes), "part", "key")
        .sortWithinPartitions("part", "key")
        .mapInArrow(link, "src bigint, dst bigint")
    )
    if not some:
        return found
    crowded = rows.join(large, ["part", "key"], "left_semi").select("print").distinct()
    codes = crowded.mapInArrow(
        partial(kernel.near_stars, distance=distance), "code bigint, print bigint, near boolean"
    )
    centres = codes.filter("near").groupBy("code").agg(F.min("print").alias("src"))
    stars = codes.join(centres, "code").select("src", F.col("print").alias("dst")).filter("src <> dst")
    return found.unionAll(stars)


def classes(prints: DataFrame, distance: int = DISTANCE, group_prints: int = GROUP_PRINTS) -> DataFrame:
    """``(print, root, component_id, n)`` for each distinct print of ``prints(print, doc_id)``.

    ``n`` is the number of its rows, ``root`` is the least print of the component and names it, ``component_id``
    its least id. Equal fingerprints are one node, so copies cost nothing
    beyond their count.
    """
    nodes = stage(
        prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct_prints"
    )
    n, both = bit_counts(nodes.select("print"))
    links = close_prints(nodes.select("print"), plan(n, both, distance), distance, group_prints)
    roots = components(links)
    member = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "least", "n", F.coalesce("root", "print").alias("root")
    )
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.join(least, "root").select("print", "root", "component_id", "n")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    distance: int = DISTANCE,
    group_prints: int = GROUP_PRINTS,
) -> DataFrame:
    """``(doc_id, print, root, component_id)`` for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the smallest id in reach over any number of links.
    Texts without words share fingerprint 0 and link like any other. Repeated
    rows each keep their row; a null id is no candidate for ``component_id``,
    which is null only where a component has no other. Columns of ``docs``
    beyond the two named are left aside.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = stage(fingerprints(own).select("doc_id", "print"), "prints")
    found = stage(classes(marked, distance, group_prints), "classes")
    return matched(marked, found, ["print"], marked.count()).select("doc_id", "print", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of the smallest id of every component, with the columns of ``docs``.

    Where ids repeat or are null, several rows may share a component's smallest
    id: then the one of least fingerprint, of least digest of its text, and of
    least hash of its other columns stays.
    """
    found = stage(near_duplicates(docs, doc_id, text), "near_duplicates")
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "print", "root")
    n, n_ids, n_roots = stays.agg(
        F.count("*"), F.count_distinct("doc_id"), F.count_distinct("root")
    ).first()
    if n == n_ids == n_roots and found.count() == found.select("doc_id").distinct().count():
        keys = stays.select(F.col("doc_id").alias(doc_id))
        return docs.join(small(keys, n), doc_id, "left_semi").select(*docs.columns)
    one = stays.groupBy("root", F.col("doc_id").alias("_id")).agg(F.min("print").alias("_print")).drop("root")
    marked = fingerprints(docs, text, into="_same")
    kept = marked.join(
        one, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_print")), "left_semi"
    )
    others = [c for c, kind in docs.dtypes if "map<" not in kind]
    order = F.struct(F.sha2(F.col(text).cast("string"), 256), F.xxhash64(*others))
    first = F.min_by(F.struct(*docs.columns), order).alias("_row")
    return kept.groupBy(doc_id, "_same").agg(first).select("_row.*")
