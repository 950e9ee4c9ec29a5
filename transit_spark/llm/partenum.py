"""Jaccard self-join of word shingles by PartEnum signatures.

Sets are put into bands of size, such that linked sets lie in one band or in neighbouring ones. In a band, linked
sets differ by at most k elements. The domain is dealt into n1 parts, of which one then holds at most one of the
differing elements, and each part into three cells; leaving out each cell in turn gives three signatures of a part,
one of which is free of differences. So linked sets always share a signature, and every pair that does is verified.

A signature without elements says nothing. Where there are few parts, it is replaced by itself combined with all
signatures of a second, independent dealing, which linked sets share as well. Where there are many, the domain is dealt
into some spare parts more than needed, a number that follows from the band: linked sets then agree in ``SHARED`` parts
more than that, so a set that loses at most so many parts by leaving out signatures without elements still shares as many
others. Only sets with more of them pay for the combined ones. So no link is lost, and pairs that share fewer are none. Signatures of near copies spread over all buckets, since each set has many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.common import bucket_count, kept, keyed, mix64, pack, pieces, text_bytes, tidy, trimmed
from transit_spark.llm.links import COUNTED, linked_components, members, sharing, split_groups
from transit_spark.session import stage

BUCKET_BYTES = 4 << 20
CACHE_WORDS = 400_000
CELLS = 3
#: From this number of parts on, spare ones are dealt, so that signatures without elements can be left out: so many, and
#: one for every ``SPARE_EVERY`` parts, since the share of such signatures is the same for sets of all sizes.
MANY_PARTS = 8
SPARE_PARTS, SPARE_EVERY = 4, 6
#: Linked sets of many parts share so many signatures, as so many less one parts are dealt besides. Pairs with fewer, which
#: frequent shingles make in a number that grows with the square of their documents, are not verified.
SHARED = 3


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word, kept per worker for the frequent ones."""
    import xxhash

    known = kept("words", 0, dict)
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; all words as one if there are fewer; empty without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out + hashes[k : k + len(out)])
    return np.unique(out)


def bands(most: int, percent: int) -> np.ndarray:
    """First sizes of the bands: sets of sizes in bands that are not neighbours cannot be linked."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all sets of a piece; the last bit says that sharing it alone counts as ``SHARED``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = bands(int(sizes.max(initial=1)), percent)
    band = np.searchsorted(starts, sizes, side="right") - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    keys, owners, one = [], [], np.uint64(1)
    for shift in (0, 1):  # with the band above, and with the band below
        joint = band - shift
        live = (joint >= 0) & (sizes > 0)
        top = starts[np.minimum(joint + 2, len(starts) - 1)] - 1
        top = np.where(joint + 2 >= len(starts), starts[-1] * 100 // percent, top)
        differ = top * 2 * (100 - percent) // (100 + percent)
        if shift:  # the band below is out of reach for some small sizes
            live &= (starts[band] - 1) * 100 >= percent * sizes
        else:
            below = (starts[band + 1] - 1) * 100 < percent * starts[band + 1]
            top_own = starts[band + 1] - 1
            differ = np.where(below, top_own * 2 * (100 - percent) // (100 + percent), differ)
        parts = np.maximum(1, (differ + 2) // 2)
        many = parts >= MANY_PARTS
        spare = np.where(many, SPARE_PARTS + parts // SPARE_EVERY, 0)
        parts = parts + spare + np.where(many, SHARED - 1, 0)
        use = live[owner]
        s, o, light, lost = _enumerated(elements[use], owner[use], len(sets), np.where(live, parts, 0), differ, joint, 1)
        keys.append(np.where(many[o], s & ~one, s | one)[~light])
        owners.append(o[~light])
        light &= ~(many & (lost <= spare))[o]
        if light.any():
            weak_s, weak_o = s[light], o[light]
            again = np.zeros(len(sets), bool)
            again[weak_o] = True
            use = again[owner]
            s2, o2, _, _ = _enumerated(elements[use], owner[use], len(sets), np.where(again, parts, 0), differ, joint, 2)
            order = np.argsort(o2, kind="stable")
            s2, o2 = s2[order], o2[order]
            lo, hi = np.searchsorted(o2, weak_o), np.searchsorted(o2, weak_o, side="right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys.append(mix64(np.repeat(weak_s, n) ^ mix64(s2[at])) | one)
            owners.append(np.repeat(weak_o, n))
    return np.concatenate(keys), np.concatenate(owners)


def _enumerated(elements, owner, n_sets, parts, differ, joint, seed):
    """Signatures of one dealing: (signature, set, whether it has no element), and by set how many parts these may cost.

    Linked sets may lose a part without elements, and of those with all elements in one cell half: each of these takes a
    differing element, which then is not one of two that spoil another part.
    """
    deal = mix64(elements ^ np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF))
    value = mix64(elements + np.uint64(seed))
    first = np.cumsum(parts) - parts
    part = ((deal >> np.uint64(34)) * parts[owner].astype(np.uint64) >> np.uint64(30)).astype(np.int64)
    cell = (deal & np.uint64(0xFFFF)).astype(np.int64) % CELLS
    total = int(parts.sum())
    at = (first[owner] + part) * CELLS + cell
    sums, counts = np.zeros(total * CELLS, np.uint64), np.bincount(at, minlength=total * CELLS)
    np.add.at(sums, at, value)
    sums, counts = sums.reshape(-1, CELLS), counts.reshape(-1, CELLS)
    own = np.repeat(np.arange(n_sets), parts)
    nth = (np.arange(total) - first[own]).astype(np.uint64)
    label = mix64(nth * np.uint64(8) + np.uint64(seed << 60) ^ mix64(joint[own].astype(np.uint64)))
    whole, filled = sums.sum(axis=1, dtype=np.uint64), counts.sum(axis=1)
    keys = [mix64(mix64(whole - sums[:, c] + np.uint64(c + 1)) ^ label) for c in range(CELLS)]
    empty = [filled == counts[:, c] for c in range(CELLS)]
    n_empty = np.sum(empty, axis=0)
    lost = np.bincount(own[n_empty == CELLS], minlength=n_sets) + (np.bincount(own[n_empty == 1], minlength=n_sets) + 1) // 2
    # sets that may not differ at all have one signature, of all elements
    exact = differ[own] == 0
    keys[0] = np.where(exact, mix64(mix64(whole) ^ label), keys[0])
    empty[0] = empty[0] & ~exact
    some = ~exact
    return (
        np.concatenate([keys[0], *[k[some] for k in keys[1:]]]),
        np.concatenate([own, *[own[some]] * (CELLS - 1)]),
        np.concatenate([empty[0], *[e[some] for e in empty[1:]]]),
        lost,
    )


def candidate_groups(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows of ``COUNTED`` for documents that share a signature; ids that are NULL are left out."""
    n_buckets = bucket_count(text_bytes(docs), BUCKET_BYTES, 64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, ids, seen = [], [], set()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = shingle_set(text, shingle)
                if len(own) and doc_id is not None:
                    sets.append(own)
                    ids.append(doc_id)
            first: dict[bytes, int] = {}
            lead = [first.setdefault(s.tobytes(), k) for k, s in enumerate(sets)]  # equal sets: the first one signs
            seen = np.array([k == f for k, f in enumerate(lead)], bool)
            ids = np.array(ids, np.int64)
            keys, owners = signatures([s for s, f in zip(sets, seen) if f], percent)
            owners = np.flatnonzero(seen)[owners]
            copies = np.flatnonzero(~seen)
            same = mix64(np.array([lead[k] for k in copies], np.uint64) + mix64(ids[[lead[k] for k in copies]])) | np.uint64(1)
            keys = np.r_[keys, same, same].astype(np.uint64)
            owners = np.r_[owners, copies, [lead[k] for k in copies]].astype(np.int64)
            # one order by bucket and document: ids of a row are a few runs
            bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(owners, kind="stable")
            rows = list(pack(bucket[order], n_buckets, keys[order].astype(np.uint32), ids[owners[order]]))
            # sizes travel in buckets of their own, below 0
            rows.append((-1 - int(keys[0] % np.uint64(n_buckets)) if len(keys) else -1, np.array([len(s) for s in sets], np.uint32).tobytes(), ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                ["bucket", "keys", "ids"],
            )

    def group(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
        nodes = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        if table.column("bucket")[0].as_py() < 0:
            kinds = pa.array(["size"] * len(keys), pa.string())
            return pa.table({"kind": kinds, "a": pa.array(nodes), "b": pa.array(keys.astype(np.int64)), "members": pa.nulls(len(keys), pa.binary()), "n": pa.nulls(len(keys), pa.int64())})
        rows = list(split_groups(keys, nodes, np.where(keys & 1, SHARED, 1)))
        empty = {"kind": pa.string(), "a": pa.int64(), "b": pa.int64(), "members": pa.binary(), "n": pa.int64()}
        return pa.Table.from_batches(rows) if rows else pa.table({k: pa.array([], t) for k, t in empty.items()})

    packed = docs.mapInArrow(trimmed(sign), "bucket int, keys binary, ids binary")
    return stage(packed.groupBy("bucket").applyInArrow(group, COUNTED))


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Two documents are linked when ``100 * common >= percent * union`` of their distinct shingles; every such pair is
    found. NULL, empty and blank texts have no shingles and are linked with nothing. Equal texts are linked. Each row
    has the size of its own set; the links of rows with equal ids are those of all of them, and they share a
    component. A NULL id is linked with nothing and its component is NULL. An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    groups = candidate_groups(rows, shingle, percent)
    tidy(docs)
    candidates = sharing(groups, SHARED)
    involved = members(candidates).withColumnRenamed("node", "doc_id")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "elements"])

    sets = stage(rows.join(involved, "doc_id", "left_semi").mapInArrow(trimmed(to_sets), "doc_id long, elements array<long>"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = [len(shingle_set(t, shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_shingles"])

    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        both = pairs.join(left, "a").join(right, "b").withColumn("common", common)
        return both.where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return sets.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi")

    found = linked_components(candidates, verify, sets_of, percent).select(F.col("node").alias("doc_id"), "component")

    # rows without a word were not sent on; an id that several rows have has several sizes, counted row by row
    sizes = groups.where("kind = 'size'").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    own = rows.select("doc_id", "text")
    several = own.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = stage(several)
    single = own.select("doc_id").where("doc_id is not null").join(several, "doc_id", "left_anti").join(sizes, "doc_id", "left")
    loose = own.where("doc_id is null").unionByName(own.join(several, "doc_id", "left_semi"))
    loose = loose.mapInArrow(trimmed(count), "doc_id long, n_shingles long")
    counted = single.withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0).cast("long"))).unionByName(loose)
    return counted.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
