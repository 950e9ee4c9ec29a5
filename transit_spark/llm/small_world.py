"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard.

Every shard of the vectors gets a graph; every vector is searched in every graph, in blocks. A search goes down the
layers with a beam and then on through all vectors within the similarity, so groups of any size are found whole. A
fixed number of vectors of the whole table is compared with every shard by brute force when its graph is built; as long
as the beam misses too many of these links it is widened, and the shard is searched with the beam that passed. Graphs
are files below the shared folder, so that any task can load any of them. Found pairs are verified by cosine in double precision, counted, and reduced to a spanning forest.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.common import components, qualified
from transit_spark.llm.token_files import file_system
from transit_spark.operators.joins import counted
from transit_spark.session import checkpoint_root, stage

SIMILARITY = 0.9
SHARDS, SHARD_ROWS = 6, 100_000
BLOCK_ROWS = 2048
LINKS, BUILD_BEAM, BEAM = 16, 48, 32
#: So many vectors of the table, by the hash of their ids, are audited in every shard; the beam doubles until this part
#: of their links is found.
AUDIT_ROWS, AUDIT_RECALL = 512, 0.99
BATCH = 256
LAYER_RATIO, TOP_ROWS = 16, 64

#: Rows that may have links.
SOUND = (
    "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
    "and exists(v, x -> x <> 0)"
)


def _top(sims: np.ndarray, ids: np.ndarray, flags: np.ndarray, n: int):
    """The n best columns of each row, best first."""
    if sims.shape[1] > n:
        part = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        sims, ids, flags = (np.take_along_axis(x, part, axis=1) for x in (sims, ids, flags))
    order = np.argsort(-sims, axis=1, kind="stable")
    return tuple(np.take_along_axis(x, order, axis=1) for x in (sims, ids, flags))


class Layer:
    """One layer: which vectors are in it and whom each links to."""

    def __init__(self, nodes: np.ndarray, width: int, total: int):
        self.nodes, self.width = nodes, width
        self.links = np.full((total, width), -1, np.int32)


class Graph:
    """A small-world graph over unit vectors; searches and insertions go in batches."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.vectors = vectors
        self.fast = vectors.astype(np.float32)
        n = len(vectors)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        sizes, size = [], n
        while size > TOP_ROWS:
            sizes.append(size)
            size //= LAYER_RATIO
        self.top = order[: max(1, size)] if n else order
        self.layers: list[Layer] = []
        for size in reversed(sizes):  # from the smallest layer down to all vectors
            layer = Layer(order[:size], LINKS * (2 if size == n else 1), n)
            self._fill(layer)
            self.layers.append(layer)

    def _entries(self, queries: np.ndarray, layers: list[Layer], n: int = 8) -> np.ndarray:
        """Where to enter the layer below: the best vectors found above it."""
        sims = queries @ self.fast[self.top].T
        n_top = min(n, len(self.top))
        found = self.top[np.argsort(-sims, axis=1, kind="stable")[:, :n_top]]
        for layer in layers:
            found = self._beam(queries, layer, found, n)[1]
        return found

    def _beam(self, queries: np.ndarray, layer: Layer, entries: np.ndarray, beam: int, low: float = 2.0):
        """The best ``beam`` vectors that the search meets, -1 where there are fewer, and all that it meets from ``low`` up.

        Returns (similarities, ids, visited, (query, vector) of those met).
        """
        n = len(queries)
        rows = np.arange(n)[:, None]
        visited = np.zeros((n, len(self.fast) + 1), bool)
        visited[:, -1] = True  # the last column is for missing links
        ids = entries.astype(np.int32)
        visited[rows, ids] = True
        sims = np.where(ids >= 0, np.einsum("qkd,qd->qk", self.fast[ids], queries), -2).astype(np.float32)
        q, k = np.nonzero(sims >= low)
        met = [(q, ids[q, k])]
        sims, ids, open_ = _top(sims, ids, ids >= 0, beam)
        live = np.arange(n)
        while len(live):
            rank = np.where(open_[live], sims[live], -3)
            width = min(4, rank.shape[1])
            picks = np.argsort(-rank, axis=1, kind="stable")[:, :width]
            chosen = np.take_along_axis(open_[live], picks, axis=1)
            keep = chosen.any(axis=1)
            live, picks, chosen = live[keep], picks[keep], chosen[keep]
            if not len(live):
                break
            open_[live[:, None], picks] = False
            near = layer.links[np.where(chosen, ids[live[:, None], picks], 0)]
            near = np.where(chosen[:, :, None], near, -1).reshape(len(live), -1)
            near = np.where(visited[live[:, None], near], -1, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            visited[live[:, None], near] = True
            q, k = np.nonzero(near >= 0)
            new = np.full(near.shape, -2, np.float32)
            new[q, k] = value = np.einsum("pd,pd->p", self.fast[near[q, k]], queries[live[q]])
            q, k = q[value >= low], k[value >= low]
            met.append((live[q], near[q, k]))
            all_ids = np.concatenate([ids[live], near.astype(np.int32)], axis=1)
            all_sims = np.concatenate([sims[live], new], axis=1)
            all_open = np.concatenate([open_[live], near >= 0], axis=1)
            s, i, o = _top(all_sims, all_ids, all_open, beam)
            if s.shape[1] > sims.shape[1]:
                pad = s.shape[1] - sims.shape[1]
                sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-2)
                ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
                open_ = np.pad(open_, ((0, 0), (0, pad)))
            sims[live, : s.shape[1]], ids[live, : s.shape[1]], open_[live, : s.shape[1]] = s, i, o
        return sims, np.where(sims > -2, ids, -1), visited, tuple(np.concatenate(x) for x in zip(*met))

    def _chosen(self, sims: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
        """Of candidates, best first: those nearer to the vector than to one already taken, then the nearest others."""
        vectors = self.fast[ids]
        between = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            close = np.where(taken, between[:, k, :], -2).max(axis=1) if k else np.full(len(ids), -2)
            taken[:, k] = (ids[:, k] >= 0) & (close < sims[:, k]) & (taken.sum(axis=1) < width)
        rank = np.where(ids < 0, 3 * ids.shape[1], np.where(taken, 0, ids.shape[1]) + np.arange(ids.shape[1]))
        order = np.argsort(rank, axis=1, kind="stable")[:, :width]
        picked = np.take_along_axis(ids, order, axis=1)
        if picked.shape[1] < width:
            picked = np.pad(picked, ((0, 0), (0, width - picked.shape[1])), constant_values=-1)
        return picked

    def _fill(self, layer: Layer) -> None:
        """Insert the layer's vectors in batches that double, each linked to what is there and to each other."""
        at, half = 0, layer.width // 2
        while at < len(layer.nodes):
            batch = layer.nodes[at : at + max(TOP_ROWS, min(at, 2 * BATCH))]
            queries = self.fast[batch]
            within = queries @ queries.T
            np.fill_diagonal(within, -2)
            n_in = min(half, len(batch) - 1)
            near = np.argsort(-within, axis=1, kind="stable")[:, :n_in]
            sims, ids = np.take_along_axis(within, near, axis=1), batch[near]
            if at:
                entries = self._entries(queries, self.layers)
                inside = np.isin(entries, layer.nodes[:at])  # vectors of upper layers come first, so they are in
                entries = np.where(inside, entries, layer.nodes[0])
                found, found_ids, *_ = self._beam(queries, layer, entries, BUILD_BEAM)
                own = found_ids == batch[:, None]
                sims = np.concatenate([sims, np.where(own, -2, found)], axis=1)
                ids = np.concatenate([ids, np.where(own, -1, found_ids)], axis=1)
            if ids.shape[1]:
                ids.sort(axis=1)
                ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
                sims = np.where(ids >= 0, np.einsum("qkd,qd->qk", self.fast[ids], queries), -2)
                sims, ids, _ = _top(sims, ids, ids >= 0, BUILD_BEAM + half)
                layer.links[batch] = self._chosen(sims, np.where(sims > -2, ids, -1), layer.width)
                self._link_back(layer, batch)
            at += len(batch)

    def _link_back(self, layer: Layer, batch: np.ndarray) -> None:
        """Links in the other direction; where there are too many, the choice is made anew."""
        source = np.repeat(batch, layer.width)
        target = layer.links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("pd,pd->p", self.fast[source], self.fast[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, begin, counts = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(begin, counts)
        use = nth < layer.width
        new = np.full((len(nodes), layer.width), -1, np.int32)
        new[np.repeat(np.arange(len(nodes)), counts)[use], nth[use]] = source[use]
        for a in range(0, len(nodes), 4 * BATCH):
            own = nodes[a : a + 4 * BATCH]
            ids = np.concatenate([layer.links[own], new[a : a + 4 * BATCH]], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("qkd,qd->qk", self.fast[ids], self.fast[own]), -2)
            sims, ids, _ = _top(sims, ids, ids >= 0, ids.shape[1])
            layer.links[own] = self._chosen(sims, np.where(sims > -2, ids, -1), layer.width)

    def within(self, queries: np.ndarray, similarity: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs with at least this cosine: the beam's, and all that links among such vectors reach."""
        low = similarity - 1e-4  # single precision finds, double precision decides
        fast = queries.astype(np.float32)
        if not self.layers:
            q, v = np.nonzero(fast @ self.fast[self.top].T >= low)
            q, v = q, self.top[v]
        else:
            base = self.layers[-1]
            entries = self._entries(fast, self.layers[:-1])
            _, _, visited, (q, v) = self._beam(fast, base, entries, beam, low)
            front_q, front_v, all_q, all_v = q, v, [q], [v]
            while len(front_q):
                near = base.links[front_v]
                fq, fv = np.repeat(front_q, near.shape[1]), near.ravel()
                fresh = ~visited[fq, fv]
                fq, fv = fq[fresh], fv[fresh]
                key = np.unique(fq.astype(np.int64) * len(self.fast) + fv)
                fq, fv = key // len(self.fast), key % len(self.fast)
                visited[fq, fv] = True
                good = np.einsum("pd,pd->p", self.fast[fv], fast[fq]) >= low
                front_q, front_v = fq[good], fv[good]
                all_q.append(front_q)
                all_v.append(front_v)
            q, v = np.concatenate(all_q), np.concatenate(all_v)
        exact = np.concatenate([np.einsum("pd,pd->p", self.vectors[v[a : a + 65536]], queries[q[a : a + 65536]]) for a in range(0, len(v), 65536)] or [np.empty(0)])
        return q[exact >= similarity], v[exact >= similarity]

    def save(self, ids: np.ndarray, weights: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=ids, weights=weights, vectors=self.vectors, top=self.top, **{f"layer{k}": x.links for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[Graph, np.ndarray, np.ndarray]:
        """The graph, the ids of its vectors and their weights."""
        self, held = cls.__new__(cls), np.load(io.BytesIO(data))
        self.vectors, self.top = held["vectors"], held["top"]
        self.fast = self.vectors.astype(np.float32)
        self.layers = []
        for k in range(len(held.files) - 4):
            links = held[f"layer{k}"]
            layer = Layer(np.empty(0, np.int32), links.shape[1], 0)
            layer.links = links
            self.layers.append(layer)
        return self, held["ids"], held["weights"]


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def audited_beam(graph: Graph, sample: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """(beam, links of the sample, links found with that beam): the beam doubles until the audit passes."""
    truth = set()
    for a in range(0, len(sample), BATCH):
        q, v = np.nonzero(sample[a : a + BATCH] @ graph.vectors.T >= similarity)
        truth |= set(zip((q + a).tolist(), v.tolist()))
    beam = BEAM
    while True:
        found = set()
        for a in range(0, len(sample), BATCH):
            q, v = graph.within(sample[a : a + BATCH], similarity, beam)
            found |= set(zip((q + a).tolist(), v.tolist()))
        hits = len(truth & found)
        if hits >= AUDIT_RECALL * len(truth) or beam >= len(graph.vectors):
            return beam, len(truth), hits
        beam *= 2


def save_file(path: str, data: bytes, attempt: int) -> None:
    """Write under a passing name and move into place, so a second attempt at a task does no harm."""
    system, inner = file_system(path)
    folder, name = os.path.split(inner)
    system.create_dir(folder)
    with system.open_output_stream(f"{folder}/.{name}.{attempt}") as out:
        out.write(data)
    system.move(f"{folder}/.{name}.{attempt}", inner)


def load_file(path: str) -> bytes:
    system, inner = file_system(path)
    with system.open_input_file(inner) as held:
        return held.read()


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(v, rep, weight): each sound vector once, with its smallest id and its number of rows."""
    return stage(rows.where(SOUND).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))


def shard_graphs(same: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(shard, size, path, beam, links, found): the graph of every shard, and its audit."""
    spark, n = same.sparkSession, same.count()
    n_shards = max(SHARDS, -(-n // SHARD_ROWS))
    folder = qualified(spark, f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/graphs-{uuid.uuid4().hex}")
    # at most AUDIT_ROWS vectors, whatever the table
    audited = same.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(AUDIT_ROWS).select("v").collect()
    samples: dict[int, list] = {}
    for row in audited:
        samples.setdefault(len(row.v), []).append(row.v)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        shard, width = table.column("shard")[0].as_py(), table.column("size")[0].as_py()
        values = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
        graph = Graph(unit(values))
        sample = unit(np.array(samples[width])) if width in samples else graph.vectors[:0]
        beam, links, found = audited_beam(graph, sample, similarity)
        path = f"{folder}/shard-{shard:06d}-{width}.npz"
        save_file(path, graph.save(table.column("rep").to_numpy(), table.column("weight").to_numpy()), TaskContext.get().taskAttemptId())
        kinds = [("shard", pa.int32()), ("size", pa.int32()), ("path", pa.string()), ("beam", pa.int32()), ("links", pa.int64()), ("found", pa.int64())]
        return pa.table([[x] for x in (shard, width, path, beam, links, found)], schema=pa.schema(kinds))

    dealt = same.select(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(n_shards)).cast("int").alias("shard"), F.size("v").alias("size"), "rep", "weight", "v")
    return stage(
        dealt.groupBy("shard", "size").applyInArrow(build, "shard int, size int, path string, beam int, links long, found long")
    )


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components are linked with nothing; vectors of
    different lengths neither. Equal vectors are searched once and counted as often as they occur. ``kept`` marks the
    smallest id of a component. Rows with equal ids count as separate vectors; a NULL id is linked with nothing.
    """
    values = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), values.alias("v"))
    same = distinct_vectors(rows)
    n = same.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n_blocks = max(1, -(-n // BLOCK_ROWS))

    def block(table: pa.Table) -> pa.Table:
        values = table.column("v").combine_chunks().flatten().to_numpy()
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                "size": pa.array([table.column("size")[0].as_py()], pa.int32()),
                "queries": pa.array([table.column("rep").to_numpy().tobytes()], pa.binary()),
                "values": pa.array([values.tobytes()], pa.binary()),
            }
        )

    graphs = shard_graphs(same, similarity)
    dealt = same.select(F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(n_blocks)).cast("int").alias("block"), F.size("v").alias("size"), "rep", "v")
    blocks = dealt.groupBy("block", "size").applyInArrow(block, "block int, size int, queries binary, values binary")
    # one row per shard and block, each dealt to a task of its own; of the graph it has the path alone
    tasks = blocks.join(counted(graphs), "size")
    tasks = tasks.repartition(min(4096, graphs.count() * n_blocks), "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for width, path, beam, queries, values in zip(*(batch.column(c).to_pylist() for c in ("size", "path", "beam", "queries", "values"))):
                if held is None or held[0] != path:
                    held = (path, *Graph.load(load_file(path)))
                _, graph, ids, weights = held
                queries = np.frombuffer(queries, np.int64)
                vectors = unit(np.frombuffer(values, np.float64).reshape(-1, width))
                counts, label = np.zeros(len(queries), np.int64), queries.copy()
                node_label = ids.copy()
                for at in range(0, len(vectors), BATCH):
                    q, v = graph.within(vectors[at : at + BATCH], similarity, beam)
                    q = q + at
                    other = ids[v] != queries[q]
                    q, v = q[other], v[other]
                    counts += np.bincount(q, weights[v], len(queries)).astype(np.int64)
                    while len(q):  # smallest label over the links, until nothing changes
                        low = np.minimum(label[q], node_label[v])
                        if (low == label[q]).all() and (low == node_label[v]).all():
                            break
                        np.minimum.at(label, q, low)
                        np.minimum.at(node_label, v, low)
                # labels of a batch join earlier ones through the vectors that they share
                moved, nodes = label != queries, node_label != ids
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[queries, ids[nodes]]),
                        pa.array(np.r_[counts, np.zeros(nodes.sum(), np.int64)]),
                        pa.array(np.r_[np.where(moved, label, queries), node_label[nodes]]),
                    ],
                    ["node", "n_links", "label"],
                )

    found = stage(tasks.select("size", "path", "beam", "queries", "values").mapInArrow(search, "node long, n_links long, label long"))
    joined = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("others"))
    classes = (
        same.join(counts, F.col("rep") == F.col("node"), "left")
        .drop("node")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("v", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    good = rows.withColumn("sound", F.coalesce(F.expr(SOUND), F.lit(False))).withColumn("v", F.when(F.col("sound"), F.col("v")))
    out = good.join(classes, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
