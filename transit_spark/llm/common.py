"""Helpers shared by the text operators: null-safe columns, packed exchanges, bounded batches, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.session import stage

T = TypeVar("T")

#: White space of the word pattern ``[^\x20\x09-\x0D]+``, as a Java class.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"
WHITE_SPACE = " \t\n\x0b\x0c\r"

#: Texts are handed on in pieces of about this many bytes, whatever the size of the Arrow batch.
PIECE_BYTES = 8 << 20
#: Where a task makes arrays many times as large as its texts.
SMALL_PIECE_BYTES = 2 << 20


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that tasks can import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_transit_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="transit-code-"), "transit_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._transit_shipped = True


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark would take for it, so that tasks write where Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """Only the columns an operator works on, under names of its own, so that no other column can clash."""
    columns = {"doc_id": id_col, "text": text_col, **more}
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; NULL counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], text_col: str = "text", n_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``n_bytes`` of text each; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(
            np.asarray(pc.binary_length(batch.column(text_col)).to_numpy(zero_copy_only=False), dtype=np.float64)
        )
        part = ((np.cumsum(sizes) - sizes) // n_bytes).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def pack(buckets: np.ndarray, n_buckets: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column) for every bucket that occurs, so that many small rows travel as few large ones."""
    order = np.argsort(buckets, kind="stable")
    sorted_buckets = buckets[order]
    cuts = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]]) if len(order) else order
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
        yield (int(sorted_buckets[a]), *[c[a:b].tobytes() for c in columns])


_kept: dict[tuple, object] = {}


def kept(kind: str, key: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, made once: one such table at a time.

    Spark hands workers on to whatever runs next, so the tables of an operator go, and their memory with them, when
    another operator keeps its own.
    """
    if (kind, key) not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            release()
        _kept[kind, key] = make()
    return _kept[kind, key]


def release() -> None:
    """Gives free memory back to the system, which the allocators otherwise hold as long as the process lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches, which gives free memory back to the system when a task is over: idle workers hold it else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, which sizes the number of buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def bucket_count(n_bytes: int, bucket_bytes: int, least: int = 12) -> int:
    """So many buckets that each stands for about ``bucket_bytes`` of input; grows with the input."""
    return max(least, -(-n_bytes // bucket_bytes))


def components(
    edges: DataFrame, a: str = "a", b: str = "b", staged: Callable[[DataFrame], DataFrame] = stage
) -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node that has an edge.

    Alternates large-star and small-star steps. Each step groups by node and keeps one row per edge, so a hub with
    millions of edges is a sum over its rows and a join that adaptive execution may split, never a list. Every step
    is written to the shared folder, which cuts the lineage and survives lost executors.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs = staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if not pairs.take(1):
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: every neighbour above u goes to the smallest of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        # small star: u's lower neighbours, and u itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        # done when every node has one lower neighbour and that neighbour has none
        many = low.where("n > 1").limit(1)
        chained = small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
        pairs = small
        tidy(edges)
        if not many.unionByName(chained.select(F.col("u"), F.col("v").alias("m"), F.lit(2).cast("long").alias("n"))).take(1):
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def tidy(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of steps that are over: it does once their plans are collected as garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
