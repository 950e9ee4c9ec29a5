"""Embedding whitening from polarised covariances.

Vectors are brought to whole numbers. For every dimension and every sum of two dimensions one exact figure is added up:
the sum of squares of the centred values. The covariance of two dimensions is then half of the variance of their sum
less their own variances, so no product of two different dimensions is ever formed. The matrix, as wide as a vector, is
put together on the driver for ``eigh``.

Whole numbers are centred at the whole part ``m`` of their mean, and what that leaves of the mean, ``r / n``, is taken
off exactly: the sum of ``(n * x - S) ** 2`` is ``n * n * sum((x - m) ** 2) - n * r * r``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.common import keyed
from transit_spark.session import stage

#: Sums leave a task as digits of so many bits, so that totals of digits stay exact longs.
DIGIT_BITS, DIGITS = 36, 6
#: Values handled at once in a task.
CELLS = 1 << 21
#: An eigenvalue below this share of the largest one is taken for zero.
ZERO_SHARE = 1e-13


@dataclass(frozen=True)
class Whitening:
    """What a fit finds: ``n`` vectors, their ``sums``, unit eigenvectors as columns and eigenvalues, largest first."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        return int((self.eigenvalues > ZERO_SHARE * max(self.eigenvalues[:1], default=0)).sum())


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(doc_id, x) of the rows whose vector has entries, all of them finite: the floor of each entry times ``scale``.

    Entries beyond the range of a long become its ends.
    """
    finite = "size(text) > 0 and forall(text, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    cells = keyed(rows, id_col, vector_col).where(f"text is not null and {finite}")
    return cells.select("doc_id", F.expr(f"transform(text, c -> floor({float(scale)}D * cast(c as double)))").alias("x"))


def fit_list(whole: DataFrame) -> DataFrame:
    """Each distinct vector once, of the length that most distinct vectors have (the greatest of such lengths).

    Copies are put together before the shuffle, so a vector that a third of the rows share is no hot key.
    """
    every = stage(whole.select("x").distinct())
    sizes = every.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    size = sizes.orderBy(F.desc("n"), F.desc("size")).select("size").first()
    return every.where(F.size("x") == (size[0] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0), np.int64)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``CELLS`` cells of work, given the cells of a row."""
    step = max(1, CELLS // max(1, cells))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def _exact(x: np.ndarray, bound: int, bits: int) -> np.ndarray:
    """``x`` as longs where figures of at most ``bound`` fit into ``bits``, else as Python's whole numbers."""
    return x if bound < 1 << bits else x.astype(object)


def added_up(vectors: DataFrame, width: int, figures: Callable[[np.ndarray], list[int]], cells: int) -> list[int]:
    """Column totals, as exact whole numbers of any size, of what ``figures`` adds up for a block of vectors.

    Each task adds up its blocks and leaves one row of digits per figure; the digits are summed by Spark. The driver
    gets ``width`` rows, whatever the number of vectors.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * width
        for batch in _blocks(batches, cells):
            totals = [a + b for a, b in zip(totals, figures(_matrix(batch.column("x"))))]
        if any(totals):
            base, last = (1 << DIGIT_BITS) - 1, DIGITS - 1
            rows = [[(t >> (DIGIT_BITS * k)) & base if k < last else t >> (DIGIT_BITS * k) for t in totals] for k in range(DIGITS)]
            names = ["k", *[f"d{k}" for k in range(DIGITS)]]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *[pa.array(r, pa.int64()) for r in rows]], names)

    schema = "k int, " + ", ".join(f"d{k} long" for k in range(DIGITS))
    digits = vectors.select("x").mapInArrow(task, schema).groupBy("k").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)])
    totals = [0] * width
    for row in digits.collect():
        totals[row["k"]] = sum(row[f"d{k}"] << (DIGIT_BITS * k) for k in range(DIGITS))
    return totals


def fit(vectors: DataFrame) -> Whitening:
    """Eigenvectors of the covariance (divisor ``n``) of distinct whole vectors of one length.

    No vectors, or vectors that are all equal, give a fit of rank 0.
    """
    count = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    n, width = int(count[0]), int(count[1])
    if not n:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)

    def plain_sums(x: np.ndarray) -> list[int]:
        return [int(t) for t in _exact(x, len(x) * _most(x), 62).sum(axis=0)]

    sums = added_up(vectors, width, plain_sums, width)
    mean = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean)]
    left, right = np.triu_indices(width, 1)

    def squares(x: np.ndarray) -> list[int]:
        spread = _most(x) + max(map(abs, mean))
        y = _exact(x, spread, 62) - np.array(mean, object if spread >= 1 << 62 else np.int64)
        y = _exact(y, 4 * len(y) * spread * spread, 62)
        out = [int(t) for t in (y * y).sum(axis=0)]
        for k in range(width - 1):  # the sums of dimension k and each later one
            both = y[:, k + 1 :] + y[:, k : k + 1]
            out += [int(t) for t in (both * both).sum(axis=0)]
        return out

    totals = added_up(vectors, width + len(left), squares, width * 2)
    own = [n * t - r * r for t, r in zip(totals, rest)]  # n * n * the variance
    both = [n * t - (rest[i] + rest[j]) ** 2 for t, i, j in zip(totals[width:], left, right)]
    cov = np.zeros((width, width))
    cov[np.diag_indices(width)] = [v / (n * n) for v in own]
    cov[left, right] = cov[right, left] = [(v - own[i] - own[j]) / (2 * n * n) for v, i, j in zip(both, left, right)]
    values, columns = np.linalg.eigh(cov)
    return Whitening(n, tuple(sums), np.maximum(values[::-1], 0), columns[:, ::-1], float(sum(own) / (n * n)))


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _whitened(x: np.ndarray, model: Whitening, parts: int) -> np.ndarray:
    """Centred values projected on the first components, over the root of their eigenvalues."""
    mean = [s // model.n for s in model.sums]
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, mean)])
    y = x.astype(object) - np.array(mean, object) if _most(x) + max(map(abs, mean)) >= 1 << 62 else x - np.array(mean, np.int64)
    return (y.astype(np.float64) - rest) @ (model.vectors[:, :parts] / np.sqrt(model.eigenvalues[:parts]))


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Of every row the sum of ``(n * x - S) ** 2``, exact; None beyond a long."""
    bound = model.n * _most(x) + max(map(abs, model.sums))
    if x.shape[1] * bound * bound < 1 << 62:
        away = model.n * x - np.array(model.sums, np.int64)
    else:
        away = model.n * x.astype(object) - np.array(model.sums, object)
    return [int(t) if t < 1 << 63 else None for t in (away * away).sum(axis=1)]


def identity_error(vectors: DataFrame, model: Whitening, parts: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity, over all vectors again."""
    width = parts + parts * parts

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in _blocks(batches, len(model.sums)):
            w = _whitened(_matrix(batch.column("x")), model, parts)
            total += np.r_[w.sum(axis=0), (w.T @ w).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], ["k", "s"])

    rows = vectors.select("x").mapInArrow(task, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(width)
    for row in rows:
        total[row["k"]] = row["s"] / model.n
    mean, square = total[:parts], total[parts:].reshape(parts, parts)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(parts)).max(initial=0.0))


def whiten(whole: DataFrame, model: Whitening, components: int = 4) -> DataFrame:
    """(doc_id, deviation, component, whitened, explained) of every row and component, where the row lies."""
    parts = min(components, model.rank)
    share = [float(e / model.trace) for e in model.eigenvalues[:parts]]
    size = len(model.sums)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, max(1, size)):
            x = _matrix(batch.column("x"))
            w = _whitened(x, model, parts)
            columns = [batch.column("doc_id"), pa.array(_deviations(x, model), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "deviation", "w"])

    kind = whole.schema["doc_id"].dataType.simpleString()
    if not parts:
        task_rows = whole.limit(0).selectExpr("doc_id", "0L as deviation", "cast(array() as array<double>) as w")
    else:
        task_rows = whole.where(F.size("x") == size).mapInArrow(task, f"doc_id {kind}, deviation long, w array<double>")
    shares = F.array(*[F.lit(s) for s in share]).cast("array<double>")
    return task_rows.select("doc_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "doc_id", "deviation", (F.col("k") + 1).alias("component"), "whitened", F.get(shares, F.col("k")).alias("explained")
    )


def whitened_rows(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256
) -> DataFrame:
    """(doc_id, component, n, deviation, whitened, explained, identity_error) of every row and component.

    The fit is over the distinct vectors, the result over all rows. Dropped are rows whose vector is NULL, empty, holds
    a NULL or an entry that is not finite, or has another length than most distinct vectors. Rows with NULL or repeated
    ids, and copies, are each returned. Components of eigenvalue zero have no rows, so a table whose vectors are all
    equal, or an empty one, gives none. A deviation beyond a long is NULL. Equal eigenvalues may take any axes.
    """
    whole = whole_vectors(rows, id_col, vector_col, scale)
    vectors = fit_list(whole)
    model = fit(vectors)
    error = identity_error(vectors, model, min(components, model.rank)) if model.rank else 0.0
    return whiten(whole, model, components).select(
        "doc_id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).alias("identity_error"),
    )
