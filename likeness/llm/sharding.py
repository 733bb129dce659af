"""Balanced label propagation: linked documents gather in shards of even size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.ranks import ranked
from likeness.llm.sizes import matched
from likeness.plans.staging import stage

SHARDS = 16
# Rounds of moves; it stops earlier when nobody gains or moves.
ROUNDS = 16
# Hubs with more than one of so many parts of all links agree on their goals on
# the driver: there are fewer of them than parts.
PARTS_BY_SHARD = 64
# Cycles of moves looked for in a round, a fraction of a millisecond each; the
# moves found so far keep the sizes, so a round may end there.
CYCLES = 5_000
HASHES = 1 << 20


def quotas(n: int, shards: int) -> np.ndarray:
    """Rows each shard holds: sizes at most one apart."""
    return n // shards + (np.arange(shards) < n % shards)


def worth(classes: np.ndarray) -> np.ndarray:
    """What a move of each class of gain is worth: see ``_gain_class``."""
    c = np.asarray(classes)
    loss = np.where(c == -1, -1.0, -2.0 * 2.0 ** np.maximum(-2 - c, 0))
    return np.where(c >= 0, 2.0 * 2.0 ** np.maximum(c, 0), loss)


def flows(
    wishes: np.ndarray, free: np.ndarray, value: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Moves that keep every shard at its size.

    ``wishes[s, t]`` rows would move from s to t, ``free[s]`` rows of s may go
    anywhere. With ``value`` the wishes have a third axis, one entry for each
    value, which may be negative: such rows move only to make room for others
    that gain more. Returns the moves granted, ``[s, t]``, and the net gain of
    each shard, which as many free rows leave (or, if negative, enter). The
    moves are a circulation of greatest value: cycles are added while one adds
    value, so exact swaps survive whatever else is refused, and shards that
    nobody wishes for take what makes room.
    """
    n = len(free)
    wishes = wishes.reshape(n, n, -1)
    value = np.full(wishes.shape[2], 2.0) if value is None else np.asarray(value, float)
    room = np.zeros((n + 1, n + 1, len(value) + 2), np.int64)
    room[:n, :n, :-2] = wishes
    room[np.arange(n), np.arange(n)] = 0
    room[:n, n, -2] = free
    room[n, :n, -1] = free.sum()
    value = np.concatenate([value, [-0.5, 0.0]])
    flow = np.zeros_like(room)
    for _ in range(CYCLES):
        forth = np.where(flow < room, value, -np.inf)
        back = np.where(flow > 0, -value, -np.inf).swapaxes(0, 1)
        cycle = _cycle(np.maximum(forth.max(axis=2), back.max(axis=2)))
        if cycle is None:
            break
        steps = []
        for s, t in zip(cycle, cycle[1:] + cycle[:1]):
            k, r = int(forth[s, t].argmax()), int(back[s, t].argmax())
            if forth[s, t, k] >= back[s, t, r]:
                steps.append((s, t, k, 1, room[s, t, k] - flow[s, t, k]))
            else:
                steps.append((t, s, r, -1, flow[t, s, r]))
        most = min(step[4] for step in steps)
        for s, t, k, sign, _ in steps:
            flow[s, t, k] += sign * most
    moves = flow[:n, :n].sum(axis=2)
    return moves, moves.sum(axis=0) - moves.sum(axis=1)


def _cycle(value: np.ndarray) -> list[int] | None:
    """Nodes of a cycle whose steps add up to more than nothing, if there is one."""
    n = len(value)
    best, before = np.zeros(n), np.full(n, -1)
    for _ in range(n):
        ways = best[:, None] + value
        reach = ways.max(axis=0)
        better = reach > best
        if not better.any():
            return None
        before[better] = ways.argmax(axis=0)[better]
        best = np.maximum(best, reach)
    at = int(np.flatnonzero(better)[0])
    for _ in range(n):
        at = int(before[at])
    cycle = [at]
    while (at := int(before[at])) != cycle[0]:
        cycle.append(at)
    return cycle[::-1]


def claims(counts: dict, quota: np.ndarray) -> tuple[dict, np.ndarray]:
    """``{hub: rows it shall have in each shard}`` and the room left in each shard.

    ``counts[hub]`` are its rows by shard. Where a hub has most rows comes
    first; no shard is promised beyond its quota.
    """
    left = quota.astype(np.int64)
    rest = {hub: int(n.sum()) for hub, n in counts.items()}
    shall = {hub: np.zeros(len(quota), np.int64) for hub in counts}
    order = sorted((-int(n[s]), -rest[hub], s, i, hub) for i, (hub, n) in enumerate(counts.items()) for s in range(len(quota)))
    for _, _, s, _, hub in order:
        take = min(int(left[s]), rest[hub])
        shall[hub][s] = take
        left[s] -= take
        rest[hub] -= take
    return shall, left


def _pulls(hub, now: np.ndarray, shall: np.ndarray) -> list[tuple]:
    """``(hub, shard, goal, strength, gain, low, high)``: which parts of a hub's rows go where."""
    surplus, lack = np.maximum(now - shall, 0), np.maximum(shall - now, 0)
    found = []
    for s in np.flatnonzero(surplus):
        taken = 0
        for t in np.flatnonzero(lack):
            k = int(min(surplus[s] - taken, lack[t]))
            if k > 0:
                low, high = (int(HASHES * x / now[s]) for x in (taken, taken + k))
                gain = max(int(shall[t]) + 1 - int(now[s]), 1)
                found.append((hub, int(s), int(t), int(shall[t]), gain, low, max(high, low + 1)))
                lack[t] -= k
                taken += k
    return found


def propagate(
    nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS
) -> DataFrame:
    """``(node, shard)`` for ``nodes(node)``, distinct, with linked ones together.

    ``links(node, hub)`` says which hubs a node hangs on: nodes of one hub are
    neighbours, and a link is cut when its node is not in the hub's main shard.
    Hubs of one node and nulls count for nothing. Every shard keeps its
    quota, n / shards up or down to a whole number, in every round: nodes start
    spread out by a hash; in a round each hub picks the shard that holds most
    of it among those with room, and large hubs, fewer than ``shards`` x
    ``PARTS_BY_SHARD``, claim rows of shards by turns, so that no shard is
    promised twice. Nodes elsewhere wish to follow the hub they would gain most
    from. As many move as swaps, longer cycles and room allow: room is made by
    nodes without links, then by linked nodes that lose less than the others
    gain. A shard that refused nodes is no goal of smaller hubs in the next
    round, then it is again. It ends when no node gains, or none can move in
    two rounds.

    State is one narrow row for each node, written each round. Through the
    driver go shards x shards counts for each power of two of a gain, and those
    of the large hubs. No nodes give no rows.
    """
    n = nodes.count()
    quota = quotas(n, shards)
    bounds = np.cumsum(quota)
    start = ranked(nodes.select("node").withColumn("_h", F.xxhash64("node")), [], ["_h", "node"])
    first = F.lit(0)
    for edge in bounds[:-1].tolist():
        first = first + F.when(F.col("place") >= edge, 1).otherwise(0)
    real = links.filter("node IS NOT NULL AND hub IS NOT NULL").distinct()
    shared = stage(real.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1"), "hubs")
    n_links = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = stage(matched(real, shared, ["hub"], n_links).select(*real.columns), "hub_links")
    large = [r.hub for r in shared.filter(F.col("n") * shards * PARTS_BY_SHARD > kept.count()).collect()]
    linked = kept.select("node").distinct().withColumn("linked", F.lit(True))
    state = stage(
        start.select("node", first.cast("int").alias("shard"))
        .join(linked, "node", "left")
        .select("node", "shard", F.coalesce("linked", F.lit(False)).alias("linked")),
        "shards",
    )
    closed: set[int] = set()
    idle = 0
    for salt in range(rounds):
        moved = _round(state, kept, large, quota, closed, salt)
        if moved is None:
            break
        after, closed = moved
        idle = idle + 1 if after is None else 0
        if idle == 2:
            break
        state = state if after is None else after
    return state.select("node", "shard")


def _gain_class(gain: Column) -> Column:
    """Powers of two of a gain from 0 on, -1 for none, those of a loss from -2 down."""
    return (
        F.when(gain > 0, F.floor(F.log2(gain)))
        .when(gain == 0, -1)
        .otherwise(-2 - F.ceil(F.log2(-gain)))
        .cast("int")
    )


def _small_pulls(tally: DataFrame, left: np.ndarray, closed: set[int], salt: int) -> DataFrame:
    """As ``_pulls``, one goal for each hub: of equal shards rather one with much room."""
    held = np.array([0 if s in closed else x for s, x in enumerate(left)])
    room = held if held.any() else left
    weight = F.element_at(F.lit((room / max(room.max(), 1)).tolist()), F.col("shard") + 1)
    u = (F.pmod(F.xxhash64("hub", "shard", F.lit(salt)), F.lit(HASHES)) + 1) / (HASHES + 1)
    at = F.pmod(F.xxhash64("hub", F.lit(salt)), F.lit(max(int(room.sum()), 1)))
    other = F.lit(None).cast("int")
    for s, edge in reversed(list(enumerate(np.cumsum(room).tolist()))):
        other = F.when(at < edge, s).otherwise(other)
    goal = tally.groupBy("hub").agg(
        F.max(F.when(weight > 0, F.struct("n", F.pow(u, 1 / weight).alias("h"), "shard"))).alias("best")
    )
    goal = goal.select(
        "hub", F.coalesce("best.n", F.lit(0)).alias("strength"), F.coalesce("best.shard", other).alias("goal")
    )
    return (
        tally.join(goal, "hub")
        .filter(F.col("goal") != F.col("shard"))
        .select("hub", "shard", "goal", "strength", (F.col("strength") + 1 - F.col("n")).alias("gain"))
    )


def _round(
    state: DataFrame, links: DataFrame, large: list, quota: np.ndarray, closed: set[int], salt: int
) -> tuple[DataFrame | None, set[int]] | None:
    """The next state, if any node moves, and the shards that refused some; None if no node would gain."""
    spark, shards = state.sparkSession, len(quota)
    hub_type = links.schema["hub"].dataType.simpleString()
    apart = F.broadcast(spark.createDataFrame([(hub,) for hub in large], f"hub {hub_type}"))
    placed = links.join(state.select("node", "shard"), "node")
    tally = stage(placed.groupBy("hub", "shard").agg(F.count("*").alias("n")), "tally")
    counts = {hub: np.zeros(shards, np.int64) for hub in large}
    for hub, s, k in tally.join(apart, "hub").select("hub", "shard", "n").collect():
        counts[hub][s] = k
    shall, left = claims(counts, quota)
    pulls = spark.createDataFrame(
        [pull for hub in large for pull in _pulls(hub, counts[hub], shall[hub])],
        f"hub {hub_type}, shard int, goal int, strength bigint, gain bigint, low bigint, high bigint",
    )
    small = _small_pulls(tally.join(apart, "hub", "left_anti"), left, closed, salt)
    at = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(HASHES))
    columns = ["node", "hub", "shard", "goal", "strength", "gain"]
    wishes = (
        placed.join(F.broadcast(pulls), ["hub", "shard"])
        .filter((at >= F.col("low")) & (at < F.col("high")))
        .select(columns)
        .unionByName(
            placed.join(apart, "hub", "left_anti").join(small, ["hub", "shard"]).select(columns)
        )
        .groupBy("node", "shard")
        .agg(F.max(F.struct("gain", "strength", F.xxhash64("hub").alias("h"), "goal")).alias("wish"))
        .select("node", "shard", "wish.*", _gain_class(F.col("wish.gain")).alias("class"))
    )
    wishes = stage(wishes, "wishes")
    found = wishes.groupBy("shard", "goal", "class").count().collect()
    classes = sorted({r["class"] for r in found})
    if not classes or classes[-1] < 0:
        return None
    wanted = np.zeros((shards, shards, len(classes)), np.int64)
    for s, t, c, count in found:
        wanted[s, t, classes.index(c)] = count
    free = np.zeros(shards, np.int64)
    for s, count in state.filter("NOT linked").groupBy("shard").count().collect():
        free[s] = count
    moves, net = flows(wanted, free, worth(classes))
    eager = wanted[:, :, np.array(classes) >= 0].sum(axis=2)
    refused = set(np.flatnonzero((moves < eager).any(axis=0)).tolist())
    if not moves.any():
        return None, refused
    granted = spark.createDataFrame(
        [(s, t, int(moves[s, t])) for s in range(shards) for t in range(shards)],
        "shard int, goal int, room bigint",
    )
    movers = (
        ranked(
            wishes.select(
                "node", "shard", "goal", "h", (-F.col("class")).alias("_less"), (-F.col("strength")).alias("_weak")
            ),
            ["shard", "goal"],
            ["_less", "_weak", "h", "node"],
        )
        .join(F.broadcast(granted), ["shard", "goal"])
        .filter("place < room")
        .select("node", "goal")
    )
    leaving = np.maximum(net, 0)
    if leaving.any():
        begin = np.cumsum(leaving) - leaving
        exits = spark.createDataFrame(
            [(s, int(leaving[s]), int(begin[s])) for s in range(shards) if leaving[s]],
            "shard int, room bigint, begin bigint",
        )
        candidates = state.filter("NOT linked").join(F.broadcast(exits), "shard")
        out = ranked(
            candidates.withColumn("_h", F.xxhash64("node")), ["shard"], ["_h", "node"]
        ).filter("place < room")
        goal, reached = F.lit(None).cast("int"), 0
        at = F.col("begin") + F.col("place")
        for t in range(shards):
            if net[t] < 0:
                goal = F.when((at >= reached) & (at < reached - int(net[t])), t).otherwise(goal)
                reached -= int(net[t])
        movers = movers.unionAll(out.select("node", goal.alias("goal")))
    after = state.join(movers, "node", "left").select(
        "node", F.coalesce("goal", "shard").alias("shard"), "linked"
    )
    return stage(after, "shards"), refused


def shard_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS
) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row.

    Documents of equal text are linked. ``size`` is the UTF-8 bytes of the text
    plus one, ``law`` is ``rows``: counts of shards differ by at most one. A
    group of copies larger than a shard fills shards one after the other.
    ``slot`` counts from 0 in each shard. Null texts are linked to nothing and
    have the checksum of no bytes; repeated rows and null ids are rows like any
    other. Other columns are left aside.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    nodes = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.length(raw).cast("bigint") + 1).alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.sha2(F.col(text).cast("string"), 256).alias("hub"),
            F.monotonically_increasing_id().alias("node"),
        ),
        "shard_nodes",
    )
    placed = propagate(nodes.select("node"), nodes.select("node", "hub"), shards, rounds)
    slots = ranked(placed, ["shard"], ["node"], "slot")
    return nodes.join(slots, "node").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
