"""From candidate groups to components, exactly and without listing the pairs of large groups.

Groups say which records may be linked. Small groups give all their pairs. A large group first gives a star around
its smallest record; once those links are verified and joined to components, a pair inside one component cannot
change the result any more, and only pairs across components are still verified. No group is cut short.

Groups overlap: near copies share many signatures, so the same pair lies in many groups, and most of its members are not
linked. Members of groups that a star leaves apart can therefore be grouped anew, by the rarest elements of their sets, of
which linked ones share one: ``_rare_groups``. A few of those are left where signatures gave hundreds; where records
have few keys anyway, as lines have, their groups are the fewer ones.

What is left after the rounds is not joined member by member either. Nodes go into blocks of a bounded size, by the largest group near them, and
two blocks that share a group meet once, as one tile. A task compares the sets of a tile and gives the links alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.common import bucket_count, components, mix64, pack, tidy
from transit_spark.session import stage

#: Groups up to this size give all their pairs at once; larger ones go by star, then across components.
PAIRED = 6
#: Rounds of one test per node before all pairs across components are verified.
ROUNDS = 3
#: A block holds about so many elements; a node counts ``NODE_ELEMENTS`` besides its own, which bounds the nodes.
BLOCK_ELEMENTS = 1 << 16
NODE_ELEMENTS = 64
#: Elements that one task of tiles is sent at a time, about, and columns of the matrices it multiplies.
TASK_ELEMENTS = 1 << 20
COLUMNS = 4096
#: Elements, with the set and size that travel with each, come in buckets of about so many bytes.
BUCKET_BYTES, ELEMENT_BYTES = 4 << 20, 20

GROUPS = "kind string, a long, b long, members binary"
#: With ``n``, the weights of the keys that give a pair or group, summed.
COUNTED = f"{GROUPS}, n long"


def split_groups(keys: np.ndarray, nodes: np.ndarray, weights: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Groups of equal keys as rows of ``COUNTED``: distinct pairs (``pair``, a < b) and large groups (``group``).

    Equal groups, which near copies make by the hundred, are given once. ``weights`` are those of the keys, 1 each by default.
    """
    order = np.lexsort((nodes, keys))
    weights = np.ones(len(keys), np.int64) if weights is None else weights[order]
    keys, nodes = keys[order], nodes[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])][: len(keys)]
    keys, nodes, weights = keys[fresh], nodes[fresh], weights[fresh]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    sizes = np.diff(np.r_[cuts, len(keys)])
    pairs, counts, large = [], [], {}
    for n in range(2, PAIRED + 1):
        own = cuts[sizes == n]
        for i in range(n):
            for j in range(i + 1, n):
                pairs.append(np.stack([nodes[own + i], nodes[own + j]], axis=1))
                counts.append(weights[own])
    for c, n in zip(cuts[sizes > PAIRED], sizes[sizes > PAIRED]):
        own = nodes[c : c + n]
        group = (int(own[0]), int(n), own.tobytes())
        large[group] = large.get(group, 0) + int(weights[c])
        pairs.append(np.stack([np.repeat(own[:1], n - 1), own[1:]], axis=1))
        counts.append(np.repeat(weights[c], n - 1))
    if pairs:
        found, at = np.unique(np.concatenate(pairs), axis=0, return_inverse=True)
        n = np.bincount(at.ravel(), np.concatenate(counts), len(found)).astype(np.int64)
        yield _rows("pair", found[:, 0], found[:, 1], n, None)
    if large:
        yield _rows("group", [g[0] for g in large], [g[1] for g in large], list(large.values()), [g[2] for g in large])


def _rows(kind: str, a, b, n, members) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(members or [None] * len(a), pa.binary()), pa.array(n, pa.int64())],
        ["kind", "a", "b", "members", "n"],
    )


def sharing(groups: DataFrame, least: int) -> DataFrame:
    """The rows of ``COUNTED`` without the pairs whose weights, summed over all buckets, are below ``least``; large groups stay."""
    pairs = groups.where("kind = 'pair'").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stage(pairs.withColumn("members", F.lit(None).cast("binary")).unionByName(groups.where("kind = 'group'")))


def members(groups: DataFrame) -> DataFrame:
    """The nodes of all pairs and large groups, each once."""
    large = groups.where("kind = 'group'").select(F.xxhash64("members").alias("key"), "members").mapInArrow(_unpack, "key long, node long")
    return groups.where("kind = 'pair'").select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group, data in zip(batch.column("key").to_pylist(), batch.column("members").to_pylist()):
            nodes = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), group)), pa.array(nodes)], ["key", "node"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): the smallest member of each group with every member, itself included; once in a batch."""
    for batch in batches:
        groups = [np.frombuffer(data, np.int64) for data in batch.column("members").to_pylist()]
        if groups:
            first = np.repeat([g[0] for g in groups], [len(g) for g in groups])
            found = np.unique(np.stack([first, np.concatenate(groups)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def _still_apart(groups: DataFrame, known: DataFrame) -> DataFrame:
    """The members (node) of large groups with several components, by the stars of groups with the same smallest member."""
    stars = groups.where("kind = 'group'").select("members").mapInArrow(_stars, "a long, b long").distinct()
    marked = stage(_labelled(_labelled(stars, known, "a", "ca"), known, "b", "cb"))
    several = marked.where("ca <> cb").select("a").distinct()
    return marked.join(several, "a", "left_semi").select(F.col("b").alias("node")).distinct()


def _bucket(values: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix64(values.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def _joined(table: pa.Table, **kinds: type) -> list[np.ndarray]:
    """The packed columns of a bucket, each as one array."""
    return [np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in kinds.items()]


def _packed(bucket: np.ndarray, n_buckets: int, **columns: np.ndarray) -> pa.Table:
    rows = list(pack(bucket, n_buckets, *columns.values()))
    out = {"bucket": pa.array([r[0] for r in rows], pa.int32())}
    return pa.table(out | {name: pa.array([r[k] for r in rows], pa.binary()) for k, name in enumerate(columns, 1)})


def _prefix(elements: np.ndarray, owners: np.ndarray, sizes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements among the rarest of their set, and whether the set may meet a larger one by them.

    With elements in one order for all sets, the first one that two linked sets share lies so far ahead in both that
    all they must share can follow: ``percent`` of the larger set, and 2 * percent / (100 + percent) of the smaller.
    Elements that no other set has come first and are not listed: they are what is missing to the size.
    """
    order = np.lexsort((elements, counts, owners))
    begin = np.flatnonzero(np.r_[True, owners[order][1:] != owners[order][:-1]][: len(order)])
    listed = np.diff(np.r_[begin, len(order)])
    size = sizes[order].astype(np.int64)
    place = np.arange(len(order)) + np.repeat(sizes[order][begin].astype(np.int64) - listed - begin, listed)
    kept = place <= size + -percent * size // 100
    smaller = place <= size + -2 * percent * size // (100 + percent)
    return order[kept], smaller[kept]


def _rare_groups(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node): groups of nodes whose sets share one of their rarest elements; all linked nodes share such a group.

    ``sets`` has node and elements. How many sets have an element is counted by element, which sets have it among their
    rarest is settled by set, and both travel packed. No list of the elements of all sets is made anywhere.
    """
    named = sets.withColumn("owner", F.xxhash64("node", "elements"))  # several rows may be one node
    total = sets.agg(F.coalesce(F.sum(F.size("elements")), F.lit(0))).first()[0]
    n_buckets = bucket_count(total * ELEMENT_BYTES, BUCKET_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, owners = batch.column("elements"), batch.column("owner").to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            part = (np.cumsum(sizes) - sizes) // TASK_ELEMENTS
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            for a, b in zip(cuts, np.r_[cuts[1:], len(part)]):
                flat, n = lists.slice(a, b - a).flatten().to_numpy(), sizes[a:b]
                columns = {"elements": flat, "owners": np.repeat(owners[a:b], n), "sizes": np.repeat(n, n).astype(np.int32)}
                yield from _packed(_bucket(flat, n_buckets), n_buckets, **columns).to_batches()

    def count(table: pa.Table) -> pa.Table:
        elements, owners, sizes = _joined(table, elements=np.int64, owners=np.int64, sizes=np.int32)
        order = np.lexsort((owners, elements))
        e, o = elements[order], owners[order]
        order = order[np.r_[True, (e[1:] != e[:-1]) | (o[1:] != o[:-1])][: len(e)]]  # a repeated row counts once
        _, at, counts = np.unique(elements[order], return_inverse=True, return_counts=True)
        counts = counts[at].astype(np.int32)
        own, counts = order[counts > 1], counts[counts > 1]
        columns = {"elements": elements[own], "owners": owners[own], "sizes": sizes[own], "counts": counts}
        return _packed(_bucket(owners[own], n_buckets), n_buckets, **columns)

    def choose(table: pa.Table) -> pa.Table:
        elements, owners, sizes, counts = _joined(table, elements=np.int64, owners=np.int64, sizes=np.int32, counts=np.int32)
        own, smaller = _prefix(elements, owners, sizes, counts, percent)
        return _packed(_bucket(elements[own], n_buckets), n_buckets, elements=elements[own], owners=owners[own], smaller=smaller)

    def meet(table: pa.Table) -> pa.Table:
        elements, owners, smaller = _joined(table, elements=np.int64, owners=np.int64, smaller=np.bool_)
        _, at, counts = np.unique(elements, return_inverse=True, return_counts=True)
        own = (counts > 1)[at] & (np.bincount(at, smaller, len(counts)) > 0)[at]
        return pa.table({"key": pa.array(elements[own]), "owner": pa.array(owners[own])})

    sent = named.select("owner", "elements").mapInArrow(deal, "bucket int, elements binary, owners binary, sizes binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "bucket int, elements binary, owners binary, sizes binary, counts binary")
    chosen = counted.groupBy("bucket").applyInArrow(choose, "bucket int, elements binary, owners binary, smaller binary")
    found = chosen.groupBy("bucket").applyInArrow(meet, "key long, owner long")
    return found.join(named.select("owner", "node").distinct(), "owner").select("key", "node").distinct()


def _common(elements: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other."""
    out = np.zeros((len(elements), len(others)), np.float32)
    if not out.size:
        return out
    flat = [np.concatenate(side) for side in (elements, others)]
    both = np.intersect1d(*flat)
    places = []
    for values, side in zip(flat, (elements, others)):
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        there = both[at] == values if len(both) else np.zeros(len(values), bool)
        places.append((np.repeat(np.arange(len(side)), [len(x) for x in side])[there], at[there]))
    for low in range(0, len(both), COLUMNS):
        width, sides = min(COLUMNS, len(both) - low), []
        for (owner, at), side in zip(places, (elements, others)):
            use = (at >= low) & (at < low + width)
            matrix = np.zeros((len(side), width), np.float32)
            matrix[owner[use], at[use] - low] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out


def _tile_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Linked pairs (a < b) of nodes at the places x and y, of those that differ in their label."""
    values, counts = np.unique(labels[np.r_[x, y]], return_counts=True)
    usual = values[counts.argmax()]
    found = []
    for own, other in ((x[labels[x] != usual], y), (x[labels[x] == usual], y[labels[y] != usual])):
        common = _common([sets[k] for k in own], [sets[k] for k in other]).astype(np.float64)
        sizes = [np.array([len(sets[k]) for k in side], np.float64) for side in (own, other)]
        linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
        i, j = np.nonzero(linked & (labels[own][:, None] != labels[other][None, :]))
        found.append(np.sort(np.stack([nodes[own[i]], nodes[other[j]]], axis=1), axis=1))
    return np.concatenate(found)


def _neighbourhoods(rows: DataFrame, steps: int = 2) -> DataFrame:
    """(node, home): the largest group within a few steps from group to overlapping group.

    Near copies share many groups, of which each may be the largest for some of them. Taking the largest one of all
    that their groups' other members are in brings them together, so that they fill few blocks.
    """
    home = rows.groupBy("node").agg(F.max(F.struct("n", "key")).alias("home"))
    for _ in range(steps):
        best = rows.join(home, "node").groupBy("key").agg(F.max("home").alias("home"))
        home = rows.join(best, "key").groupBy("node").agg(F.max("home").alias("home"))
    return stage(home.select("node", F.col("home.key").alias("home")))


def _links_across(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) between nodes with different ``c`` of a group: ``rows`` has key, node, c and the group's size n.

    A pair of blocks that share a group is compared in full, so a link may also come from two nodes that share none.
    """
    labels = rows.groupBy("node").agg(F.min("c").alias("c")).join(_neighbourhoods(rows), "node")
    home = stage(labels.select("node", "c", "home"))
    weighed = home.join(sets_of(home.select("node")), "node").withColumn("weight", F.size("elements") + F.lit(NODE_ELEMENTS))
    loads = weighed.groupBy("home").agg(F.sum("weight").alias("load"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("load") / BLOCK_ELEMENTS))
    placed = stage(weighed.join(loads, "home").select("node", "c", "elements", "weight", F.xxhash64("home", part).alias("block")))
    own = placed.select("node", "block")
    held = rows.join(own, "node").groupBy("key", "block").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    shapes = held.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "low", "high"))).alias("blocks"))
    shapes = shapes.select("blocks").distinct().select(F.xxhash64("blocks").alias("shape"), F.explode("blocks").alias("x"))
    held = stage(shapes.select("shape", "x.*"))
    right = held.select(F.col("shape").alias("s"), F.col("block").alias("bb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    meet = held.join(right, F.expr("shape = s and block <= bb and (low <> high or lb <> hb or low <> lb)"))
    tiles = meet.select(F.col("block").alias("ba"), "bb").distinct()
    sides = stage(tiles.select("ba", "bb", F.explode(F.array_distinct(F.array("ba", "bb"))).alias("block")))
    weights = placed.groupBy("block").agg(F.sum("weight").alias("weight"))
    load = sides.join(weights, "block").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    n_tasks = max(12, -(-load // TASK_ELEMENTS))
    sent = sides.join(placed.drop("weight"), "block").withColumn("task", F.pmod(F.xxhash64("ba", "bb"), F.lit(n_tasks)))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ba, bb, block, nodes, labels = (table.column(k).to_numpy() for k in ("ba", "bb", "block", "node", "c"))
        lists = table.column("elements").combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        order = np.lexsort((block, bb, ba))
        a, b = ba[order], bb[order]
        cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        found = [np.empty((0, 2), np.int64)]
        for low, high in zip(cuts, np.r_[cuts[1:], len(order)]):
            own = order[low:high]
            first = block[own] == ba[own[0]]
            x = own[first]
            found.append(_tile_links(nodes, labels, sets, x, x if ba[own[0]] == bb[own[0]] else own[~first], percent))
        linked = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(linked[:, 0]), "b": pa.array(linked[:, 1])})

    return sent.groupBy("task").applyInArrow(compare, "a long, b long")


def linked_components(
    groups: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    sets_of: Callable[[DataFrame], DataFrame],
    percent: int,
    by_rarity: bool = True,
) -> DataFrame:
    """(node, component) from rows of ``GROUPS``; ``verify`` keeps the pairs (a, b) that are linked.

    ``sets_of`` gives a row (node, elements) of distinct 64-bit elements for each of the nodes it is given, those alone
    that are still compared at the end; two are linked when 100 * common >= ``percent`` * union.

    First each node is verified against its smallest partner. With ``by_rarity``, members of large groups that are still
    apart are grouped anew, by rare elements: for records with very many keys. Then, round by round, nodes that are still apart from others of their groups are verified
    against one of those, the hub of the round. Groups of near copies grow
    together so with one test per node and round. When few pairs across components are left, or after ``ROUNDS``
    rounds, all that are left are compared, so no link is lost.
    """
    pairs = stage(groups.where("kind = 'pair'").select("a", "b").distinct())
    n_nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().count()
    tested = stage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    known = components(verify(tested))
    if by_rarity:
        sets = stage(sets_of(_still_apart(groups, known)).select("node", "elements"))
        rows = stage(_rare_groups(sets, percent))
        sets_of = lambda nodes: sets.join(nodes, "node", "left_semi")
    else:
        large = groups.where("kind = 'group'").select(F.xxhash64("members").alias("key"), "members").dropDuplicates(["members"])
        rows = stage(large.mapInArrow(_unpack, "key long, node long"))
    turn = 0
    while True:
        tidy(groups)
        # what may still join components: pairs across them, groups with several of them
        apart = _labelled(_labelled(pairs.select("a", "b"), known, "a", "ca"), known, "b", "cb").where("ca <> cb")
        pairs = stage(apart.select("a", "b").join(tested, ["a", "b"], "left_anti"))
        marked = stage(_labelled(rows.select("key", "node"), known, "node", "c"))
        hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("hub"), F.col("c").alias("hub_c")))
        sizes = marked.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), hub.alias("hub"))
        rows = stage(marked.join(sizes.where("low < high"), "key").select("key", "node", "c", "n", "low", "hub.hub", "hub.hub_c"))
        left = rows.where("c <> low").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + pairs.count()
        if left <= 2 * n_nodes or turn >= ROUNDS:
            break
        turn += 1
        star = rows.where("c <> hub_c").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.col("node").alias("of"))
        tests = star.unionByName(pairs.select("a", "b", F.col("b").alias("of")))
        one = F.min(F.struct(F.xxhash64("a", "b", F.lit(turn)), "a", "b")).alias("t")
        now = stage(tests.groupBy("of").agg(one).select("t.a", "t.b").distinct().join(tested, ["a", "b"], "left_anti"))
        tested = stage(tested.unionByName(now))
        known = _grown(known, verify(now))
    # groups with several components: the members that differ in theirs, tile by tile
    tidy(groups)
    across = _links_across(rows.select("key", "node", "c", "n"), sets_of, percent)
    return _grown(known, verify(pairs).unionByName(across))


def _labelled(df: DataFrame, known: DataFrame, node: str, label: str) -> DataFrame:
    """The rows with the component of a node: itself where none is known."""
    found = known.select(F.col("node").alias(node), F.col("component").alias(label))
    return df.join(found, node, "left").withColumn(label, F.coalesce(label, node))


def _grown(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links: only components that a link joins are joined, not their nodes once more.

    ``known`` has no row for the smallest node of a component, so what is joined adds a row for those that no longer
    are the smallest and changes the component of the rows below them.
    """
    ends = _labelled(_labelled(links.select("a", "b"), known, "a", "ca"), known, "b", "cb")
    joined = components(ends, "ca", "cb")
    now = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
    moved = known.join(now, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return stage(moved.unionByName(joined))
