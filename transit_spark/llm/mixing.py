"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). Words flow from patterns to the
quotas of their sources; a pattern offers its words once for nothing, again at a cost, and a third time at a higher
one. The flow says how many words each pattern gives to each source, and a seeded order of the pattern's documents
says which ones give them.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.common import fresh, keyed, word_count

REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20
#: The seeded order of a pattern is cut into so many stretches, totalled first and numbered inside after that.
STRETCHES = 1024


def share_targets(sizes: Sequence[int], weights: Sequence[float], repeats: int = REPEATS) -> list[float]:
    """All words shared by weight; no source above ``repeats`` times its size, the excess shared anew by weight."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if weights[k] * left / weight > repeats * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = weights[k] * left / weight
            break
        for k in over:
            targets[k] = float(repeats * sizes[k])
            left -= targets[k]
            open_.discard(k)
    return targets


def whole_quotas(targets: Sequence[float]) -> list[int]:
    """Whole numbers of words next to the targets, with the same rounded sum."""
    floors = [int(t) for t in targets]
    rest = round(sum(targets)) - sum(floors)
    for k in sorted(range(len(targets)), key=lambda k: (floors[k] - targets[k], k))[:rest]:
        floors[k] += 1
    return floors


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int = REPEATS) -> dict[tuple[int, int], int]:
    """Words from each pattern to each of its sources that fill the quotas at the least cost of repeats.

    The r-th pass over a pattern costs r * r a word, so passes spread before they pile up. Shortest augmenting paths
    with potentials; the network has a node per pattern and per source, not per document.
    """
    n_p, n_s = len(capacity), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    to, room, cost, out = [], [], [], [[] for _ in range(n_p + n_s + 2)]

    def edge(a: int, b: int, cap: int, price: int) -> int:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
        return len(to) - 2

    links = {}
    for p in range(n_p):
        for r in range(repeats):
            edge(start, p, capacity[p], r * r)
        for s in members[p]:
            links[p, s] = edge(p, n_p + s, repeats * capacity[p], 0)
    for s in range(n_s):
        edge(n_p + s, end, quotas[s], 0)
    potential = [0] * len(out)
    while True:
        far, via = [None] * len(out), [None] * len(out)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                if room[e]:
                    b, new = to[e], d + cost[e] + potential[a] - potential[to[e]]
                    if far[b] is None or new < far[b]:
                        far[b], via[b] = new, e
                        heapq.heappush(heap, (new, b))
        if far[end] is None:
            return {k: room[e ^ 1] for k, e in links.items() if room[e ^ 1]}
        highest = max(d for d in far if d is not None)
        potential = [p + (highest if d is None else d) for p, d in zip(potential, far)]
        path, a = [], end
        while a != start:
            path.append(via[a])
            a = to[via[a] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def mix(docs: DataFrame, sources: Column, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sources, size, taken, taken_by) for every row.

    ``sources`` is an array of strings, the sources that a row belongs to; an element may be NULL, which is a source
    like others and comes last. A NULL or empty array gives nothing. Sources in order of code points weigh
    ``weights`` in turn. ``taken`` counts words, at most ``repeats`` times the row's size; ``taken_by`` says which
    source they were taken for, with that source's size and target. The row where a quota ends gives part of its
    words. A NULL text has size 0 and gives 0; an empty table gives an empty result. Reruns agree: the order is a hash
    of the id and the seed.

    Patterns and sources are collected (one row each: the flow's nodes); documents never are. A pattern's order is
    cut into stretches of hash values, so a source with most of the rows is numbered by many tasks.
    """
    extra = fresh(docs.columns, "__sources")[0]
    rows = keyed(docs.withColumn(extra, sources), id_col, text_col, sources=extra).select(
        "doc_id", F.array_sort(F.array_distinct("sources")).alias("sources"), word_count(F.col("text")).alias("size")
    )
    patterns = rows.groupBy("sources").agg(F.sum("size").alias("size")).where("size(sources) > 0").collect()
    patterns = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p["sources"]])
    names = sorted({s for p in patterns for s in p["sources"]}, key=lambda s: (s is None, s or ""))
    place = {s: k for k, s in enumerate(names)}
    members = [[place[s] for s in p["sources"]] for p in patterns]
    sizes = [sum(p["size"] for p, own in zip(patterns, members) if k in own) for k in range(len(names))]
    targets = share_targets(sizes, [weights[k % len(weights)] for k in range(len(names))], repeats)
    flow = min_cost_flow([p["size"] for p in patterns], members, whole_quotas(targets), repeats)
    spans = []
    for k, p in enumerate(patterns):
        own, at = [], 0
        for s in members[k]:
            got = flow.get((k, s), 0)
            own.append((names[s], sizes[s], targets[s], at, at + got))
            at += got
        spans.append((p["sources"], p["size"], own))
    kind = "sources array<string>, pattern_size long, spans array<struct<source: string, source_size: long, target: double, lo: long, hi: long>>"
    plan = docs.sparkSession.createDataFrame(spans, kind).withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"}))
    hashed = rows.withColumn("hash", F.xxhash64("doc_id", F.lit(seed))).withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"}))
    hashed = hashed.withColumn("stretch", F.pmod("hash", F.lit(STRETCHES)).cast("int"))
    totals = hashed.groupBy("pattern", "stretch").agg(F.sum("size").alias("words"))
    offsets = totals.withColumn("before", F.expr("sum(words) over (partition by pattern order by stretch) - words"))
    within = F.expr("sum(size) over (partition by pattern, stretch order by hash, doc_id, size rows unbounded preceding) - size")
    placed = (
        hashed.withColumn("inside", within)
        .join(offsets.select("pattern", "stretch", "before"), ["pattern", "stretch"], "left")
        .join(F.broadcast(plan.drop("sources")), "pattern", "left")
        .withColumn("at", F.col("before") + F.col("inside"))
    )
    overlap = "greatest(0L, least(s.hi, r * pattern_size + at + size) - greatest(s.lo, r * pattern_size + at))"
    taken = f"""coalesce(transform(spans, s -> struct(s.source as source, s.source_size as source_size, s.target as target,
        aggregate(sequence(0L, {repeats - 1}L), 0L, (acc, r) -> acc + {overlap}) as words)), array())"""
    return placed.withColumn("taken_by", F.expr(taken)).select(
        "doc_id", "sources", "size", F.expr("aggregate(taken_by, 0L, (acc, t) -> acc + t.words)").alias("taken"), "taken_by"
    )


def mixed_rows(docs: DataFrame, source_col: str = "source", weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it.

    A part of half a text or more counts as a whole. Rows without a word are taken never. Of rows with equal or NULL
    ids each is repeated as often as the one of them that the mix takes most often.
    """
    id_name, copies_name, nth_name = fresh(docs.columns, "__id", "__copies", "__nth")
    taken = mix(docs, F.array(F.col(f"`{source_col}`")), weights, repeats, id_col=id_col, text_col=text_col)
    most = F.expr("max(int(floor((taken + size / 2) / size)))").alias(copies_name)
    copies = taken.where("size > 0").groupBy(F.col("doc_id").alias(id_name)).agg(most)
    worded = word_count(F.col(f"`{text_col}`")) > 0
    return (
        docs.where(worded)
        .join(copies.where(F.col(copies_name) > 0), F.col(f"`{id_col}`").eqNullSafe(F.col(id_name)))
        .withColumn(nth_name, F.explode(F.sequence(F.lit(1), F.col(copies_name))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
