"""Fuzzy line dedup by MinHash over the whole corpus.

A line's set are its character shingles. One permutation hashing gives its signature in one pass over the shingles;
bands of the signature are the keys under which lines meet. Candidates are verified by exact Jaccard, joined to
components, and of each component the first line in the corpus stays.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.common import SMALL_PIECE_BYTES, bucket_count, fresh, keyed, mix64, pack, pieces, text_bytes, tidy
from transit_spark.llm.links import COUNTED, linked_components, split_groups
from transit_spark.session import stage

SHINGLE = 8
SIMILARITY = 0.8
#: Lines as similar as 0.8 meet in a band with a probability of 1 - (1 - 0.8 ** 4) ** 12 = 0.998.
ROWS, BANDS = 4, 12
BUCKET_BYTES = 4 << 20
#: The arrays of a signature stay in a processor's cache.
PART_CHARS = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def line_nodes(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines that have a word."""
    # most lines begin with a word, which a look at the first character shows
    return [(k, line) for k, line in enumerate((text or "").split("\n")) if line and (line[0] > " " or line.strip(" \t\x0b\x0c\r"))]


@functools.cache
def _digest() -> Callable[[bytes], int]:
    import xxhash

    return xxhash.xxh3_64_intdigest


def node(line: str) -> int:
    """A signed 64-bit hash of the line, by which equal lines are one."""
    value = _digest()(line.encode())
    return value - (1 << 64) if value >> 63 else value


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    """Distinct character shingles; a shorter line is one shingle."""
    return {line[k : k + size] for k in range(max(1, len(line) - size + 1))}


def shingle_hashes(line: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the line's shingles."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = min(size, len(points))
    out = np.full(len(points) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out + points[k : k + len(out)])
    return np.unique(out.view(np.int64))


@functools.cache
def _turns(width: int) -> np.ndarray:
    """The cells from which each empty cell takes its value, attempt by attempt."""
    attempts = np.arange(1, 400, dtype=np.uint64)[:, None]
    return (mix64(np.arange(width, dtype=np.uint64) * np.uint64(1 << 20) + attempts) % np.uint64(width)).astype(np.int64)


def band_keys(lines: list[str]) -> np.ndarray:
    """Keys of all bands, one row per line."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(x) for x in lines], np.int64)
    begin = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        rolled, reach = points + np.uint64(1), 1
        while reach < SHINGLE:  # doubles the reach: SHINGLE is a power of two
            power = np.uint64(pow(_BASE, reach, 1 << 64))
            behind = rolled[reach:].copy()
            rolled *= power
            rolled[: len(behind)] += behind
            reach *= 2
    counts = np.maximum(1, lengths - SHINGLE + 1)
    before = np.cumsum(counts) - counts
    values = mix64(rolled[np.arange(counts.sum()) + np.repeat(begin - before, counts)])
    for k in np.flatnonzero(lengths < SHINGLE):  # what stands behind a short line is no part of it
        values[before[k]] = np.uint64(node(lines[k]) & 0xFFFFFFFFFFFFFFFF)
    width = ROWS * BANDS
    cell = ((values >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).view(np.int64)
    cell += np.repeat(np.arange(len(lines)) * width, counts)
    none = np.uint64(1 << 32)
    least = np.full(len(lines) * width, none, np.uint64)
    np.minimum.at(least, cell, values & np.uint64(0xFFFFFFFF))
    least = least.reshape(-1, width)
    # an empty cell takes the value of a cell chosen by a fixed sequence of its own
    full = least != none
    out = least.copy()
    rows, cells = np.nonzero(~full)
    for turns in _turns(width):
        if not len(rows):
            break
        source = turns[cells]
        good = full[rows, source]
        out[rows[good], cells[good]] = least[rows[good], source[good]]
        rows, cells = rows[~good], cells[~good]
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(3) + out.reshape(-1, BANDS, ROWS)[:, :, r] + np.uint64(1))
    return mix64(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE & 0xFFFFFFFF))


def parts_of(lines: list[str]) -> Iterator[list[str]]:
    """Runs of lines with about ``PART_CHARS`` characters, which bounds the arrays of a signature."""
    held, size = [], 0
    for line in lines:
        held.append(line)
        size += len(line)
        if size >= PART_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def distinct_lines(texts: list[str | None]) -> dict[int, str]:
    found: dict[int, str] = {}
    for text in texts:
        for _, line in line_nodes(text):
            found.setdefault(node(line), line)
    return found


def candidate_groups(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of ``COUNTED`` for lines that share a band; equal lines of a piece travel once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, n_bytes=2 * SMALL_PIECE_BYTES):
            found = distinct_lines(batch.column("text").to_pylist())
            if not found:
                continue
            keys = np.concatenate([band_keys(part) for part in parts_of(list(found.values()))]).ravel()
            nodes = np.repeat(np.fromiter(found, np.int64, len(found)), BANDS)
            bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            packed = list(pack(bucket, n_buckets, keys.astype(np.uint32), nodes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in packed], pa.int32()), pa.array([p[1] for p in packed], pa.binary()), pa.array([p[2] for p in packed], pa.binary())],
                ["bucket", "keys", "ids"],
            )

    def group(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
        nodes = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        found = list(split_groups(keys, nodes))
        empty = {"kind": pa.string(), "a": pa.int64(), "b": pa.int64(), "members": pa.binary(), "n": pa.int64()}
        return pa.Table.from_batches(found) if found else pa.table({k: pa.array([], t) for k, t in empty.items()})

    packed = rows.select("text").mapInArrow(sign, "bucket int, keys binary, ids binary")
    return stage(packed.groupBy("bucket").applyInArrow(group, COUNTED))


def lines_of(rows: DataFrame, wanted: DataFrame, n_buckets: int) -> DataFrame:
    """(node, line) of the wanted nodes. Lines travel compressed, by bucket, and only wanted ones come out."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches):
            found = distinct_lines(batch.column("text").to_pylist())
            parts: dict[int, list[int]] = {}
            for n in found:
                parts.setdefault(n % n_buckets, []).append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(parts), pa.int32()),
                    pa.array([np.array(p, np.int64).tobytes() for p in parts.values()], pa.binary()),
                    pa.array([squeeze.compress("\n".join([found[n] for n in p]).encode()) for p in parts.values()], pa.binary()),
                ],
                ["bucket", "nodes", "lines"],
            )

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        expand, wish = zstandard.ZstdDecompressor(), set(right.column("node").to_pylist())
        out: dict[int, str] = {}
        if wish:
            for nodes, data in zip(left.column("nodes").to_pylist(), left.column("lines").to_pylist()):
                for n, line in zip(np.frombuffer(nodes, np.int64).tolist(), expand.decompress(data).decode().split("\n")):
                    if n in wish:
                        out[n] = line
        return pa.table({"node": pa.array(list(out), pa.int64()), "line": pa.array(list(out.values()), pa.string())})

    sent = rows.select("text").mapInArrow(send, "bucket int, nodes binary, lines binary")
    wishes = wanted.select(F.pmod("node", F.lit(n_buckets)).cast("int").alias("bucket"), "node")
    return sent.groupBy("bucket").cogroup(wishes.groupBy("bucket")).applyInArrow(pick, "node long, line string")


def packed_shingles(x: str, y: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct shingles of both lines, each packed into 64 bits without loss; None where they don't fit.

    A shingle is as many characters as an integer has bytes, so one byte for a character is needed: its code point, or
    its place among the characters of the two lines.
    """
    if min(len(x), len(y)) < SHINGLE:
        return None
    try:
        own = x.encode("latin-1"), y.encode("latin-1")
    except UnicodeEncodeError:
        letters, points = np.unique(np.frombuffer((x + y).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
        if len(letters) > 256:
            return None
        both = points.astype(np.uint8).tobytes()
        own = both[: len(x)], both[len(x) :]
    found = []
    for t in own:
        values = np.sort(np.ndarray(len(t) - SHINGLE + 1, np.uint64, t, strides=(1,)))
        new = values[1:] != values[:-1]
        found.append(values if new.all() else np.concatenate([values[:1], values[1:][new]]))
    return found[0], found[1]


def common_shingles(x: str, y: str) -> tuple[int, int, int]:
    """Distinct shingles of one line, of the other, and of both; the last is 0 where the sizes alone rule a link out."""
    packed = packed_shingles(x, y)
    if packed is None:
        a, b = shingles(x), shingles(y)
        return len(a), len(b), len(a & b)
    a, b = packed
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return len(a), len(b), 0
    both = np.sort(np.concatenate([a, b]))
    return len(a), len(b), int(np.count_nonzero(both[1:] == both[:-1]))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            a, b, common = common_shingles(x, y)
            good.append(common >= SIMILARITY * (a + b - common))
        yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])


def _firsts(nodes: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal lines, by document and number, and of those that aren't at its place."""
    order = np.lexsort((numbers, ids, nodes))
    first = np.ones(len(order), bool)
    first[1:] = nodes[order][1:] != nodes[order][:-1]
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = (ids[order] != ids[lead]) | (numbers[order] != numbers[lead])
    return order[first], order[later]


def line_places(rows: DataFrame, found: DataFrame, n_buckets: int) -> DataFrame:
    """(doc_id, number, c): lines that equal an earlier one, with c NULL, and the first of each node of a component c.

    Of equal lines only the first can stay, so a piece sends one of them on by its node, packed, and a bucket hands on
    one. Lines that are like no other end here.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, n_bytes=SMALL_PIECE_BYTES):
            triples = [(node(line), d, k) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for k, line in line_nodes(t)]
            if not triples:
                continue
            nodes, ids, numbers = (np.array(x, np.int64) for x in zip(*triples))
            first, later = _firsts(nodes, ids, numbers)
            own = np.r_[first, later]
            again = np.arange(len(own)) >= len(first)
            bucket = np.where(again, ids[own], nodes[own]) % n_buckets
            packed = list(zip(*pack(bucket, n_buckets, nodes[own], ids[own], numbers[own].astype(np.int32), again)))
            yield pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int32()), *[pa.array(p, pa.binary()) for p in packed[1:]]], ["bucket", "nodes", "ids", "numbers", "again"])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"nodes": np.int64, "ids": np.int64, "numbers": np.int32, "again": np.bool_}
        nodes, ids, numbers, again = (np.frombuffer(b"".join(left.column(c).to_pylist()), kind) for c, kind in kinds.items())
        order = np.argsort(right.column("node").to_numpy())
        known, labels = (right.column(c).to_numpy()[order] for c in ("node", "component"))
        fresh = np.flatnonzero(~again)
        first, later = (fresh[x] for x in _firsts(nodes[fresh], ids[fresh], numbers[fresh]))
        at = np.minimum(np.searchsorted(known, nodes[first]), max(0, len(known) - 1))
        inside = known[at] == nodes[first] if len(known) else np.zeros(len(first), bool)
        c = pa.array(labels[at[inside]] if len(known) else [], pa.int64())
        gone = np.r_[later, np.flatnonzero(again)]
        own = np.r_[first[inside], gone]
        columns = [pa.array(ids[own]), pa.array(numbers[own]), pa.concat_arrays([c, pa.nulls(len(gone), pa.int64())])]
        return pa.table(dict(zip(("doc_id", "number", "c"), columns)))

    sent = rows.mapInArrow(number, "bucket int, nodes binary, ids binary, numbers binary, again binary")
    members = found.select("node", "component").unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    members = members.withColumn("bucket", F.pmod("node", F.lit(n_buckets)).cast("int"))
    return stage(sent.groupBy("bucket").cogroup(members.groupBy("bucket")).applyInArrow(settle, "doc_id long, number int, c long"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, removed): the numbers of a document's lines, from 0, that repeat an earlier one; only documents with any.

    Lines are those between line feeds that have a word. Two are linked when the Jaccard similarity of their
    8-character shingles is 0.8 or more; equal lines always are. Of each component the line with the smallest
    (doc_id, number) stays. NULL and empty texts have no lines. Rows with a NULL id keep their lines and are no
    reason to remove others; rows with equal ids count as one document.
    """
    rows = keyed(docs, id_col, text_col).where("doc_id is not null")
    n_buckets = bucket_count(text_bytes(rows), BUCKET_BYTES, 64)
    groups = candidate_groups(rows, n_buckets)
    tidy(docs)
    involved = groups.where("kind = 'pair'").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = stage(lines_of(rows, involved, n_buckets))
    tidy(docs)

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("line").alias("x"))
        right = texts.select(F.col("node").alias("b"), F.col("line").alias("y"))
        return pairs.join(left, "a").join(right, "b").mapInArrow(_similar, "a long, b long")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "line", SMALL_PIECE_BYTES):
            own = [shingle_hashes(line) for line in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "elements"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        return texts.join(nodes, "node", "left_semi").mapInArrow(to_sets, "node long, elements array<long>")

    found = linked_components(groups, verify, sets_of, round(100 * SIMILARITY), by_rarity=False)

    places = line_places(rows, found, n_buckets)
    own = places.where("c is not null")
    keepers = own.groupBy("c").agg(F.min(F.struct("doc_id", "number")).alias("k"))
    gone = own.join(keepers, "c").where("struct(doc_id, number) <> k").select("doc_id", "number")
    gone = gone.unionByName(places.where("c is null").select("doc_id", "number"))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("number")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, the repeated lines gone from the text, and last ``__removed``, how many.

    Where the input has a column of that name, the added one has underscores behind its name. Rows with a NULL id and
    NULL texts stay as they are; each of several rows with one id loses the lines whose numbers were found for the id;
    an empty table gives no rows.
    """
    id_name, gone_name, removed_name = fresh(docs.columns, "__id", "__gone", "__removed")
    removed = repeated_lines(docs, id_col, text_col).select(F.col("doc_id").alias(id_name), F.col("removed").alias(gone_name))
    gone = F.col(gone_name)
    parts = F.transform(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda line, k: F.struct(line.alias("line"), k.alias("k")))
    kept = F.filter(parts, lambda x: ~F.array_contains(gone, x["k"]))
    text = F.when(gone.isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    joined = docs.join(removed, F.col(f"`{id_col}`") == F.col(id_name), "left")
    others = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*others, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed_name))
