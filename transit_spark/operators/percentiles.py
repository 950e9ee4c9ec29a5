"""Exact percentiles of whole columns by refining value ranges: no sort, no window, no shuffle of values.

Ranks are known once a column is counted. Every round counts the rows of each range that still holds a wanted rank in
``BUCKETS`` parts of it, with the smallest and largest value of each part, and goes on with the part that holds the
rank, until its two ends are one value. A round is one pass that returns at most ``BUCKETS`` rows for each range. Parts
are of equal width, or of equal ratio where the ends are far apart, so a handful of rounds settles any doubles.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1024
#: Ends whose ratio is above this are cut into parts of equal ratio.
WIDE = 16.0


@dataclass(frozen=True)
class _Range:
    """The values of one column from ``low`` to ``high``, of one sign; so many rows of the column lie below."""

    column: str
    low: float
    high: float
    below: int

    def bucket(self) -> Column:
        """Number of the part a value is in, never falling as values rise; NULL outside the range."""
        value = F.col(f"`{self.column}`")
        mirrored = self.high < 0
        low, high = (-self.high, -self.low) if mirrored else (self.low, self.high)
        size = -value if mirrored else value
        if high / low > WIDE:
            share = (F.ln(size) - math.log(low)) / (math.log(high) - math.log(low))
        else:
            share = (size - low) / (high - low)
        part = F.least(F.greatest(F.floor(share * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
        inside = F.when((value >= self.low) & (value <= self.high), BUCKETS - 1 - part if mirrored else part)
        return inside


def percentiles(df: DataFrame, columns: Sequence[str], points: Mapping[str, float]) -> DataFrame:
    """``(column, <point>, ...)``: interpolated percentiles, one row for each column, NULL where it has no value.

    NULLs are left out; NaN counts as larger than every number. ``df`` is read once for the counts and once a round, so
    it should be stored rather than computed. Ties and repeated rows count as often as they occur.
    """
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    regions = _regions(values, columns)
    totals = {c: sum(n for n, _ in parts) for c, parts in regions.items()}
    wanted = {
        (c, rank)
        for c in columns
        if totals[c]
        for fraction in points.values()
        for rank in (math.floor((totals[c] - 1) * fraction), math.ceil((totals[c] - 1) * fraction))
    }
    found = _select(values, regions, wanted)

    def between(c: str, fraction: float) -> float | None:
        if not totals[c]:
            return None
        place = (totals[c] - 1) * fraction
        low, high = found[c, math.floor(place)], found[c, math.ceil(place)]
        return low if low == high else low + (high - low) * (place - math.floor(place))

    rows = [(c, *[between(c, p) for p in points.values()]) for c in columns]
    schema = "column STRING, " + ", ".join(f"`{name}` DOUBLE" for name in points)
    return df.sparkSession.createDataFrame(rows, schema)


def _regions(values: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[int, tuple[float, float]]]]:
    """Of each column, in rising order, (rows, (smallest, largest)) of infinities, negatives, zero, positives and NaN."""
    measures = []
    for c in columns:
        v = F.col(f"`{c}`")
        infinite = F.abs(v) == float("inf")
        number = ~F.isnan(v) & ~infinite
        kinds = [infinite & (v < 0), number & (v < 0), v == 0, number & (v > 0), infinite & (v > 0), F.isnan(v)]
        for kind in kinds:
            measures += [F.count(F.when(kind, 1)), F.min(F.when(kind, v)), F.max(F.when(kind, v))]
    got = values.agg(*[m.alias(f"m{k}") for k, m in enumerate(measures)]).first()
    found = {}
    for k, c in enumerate(columns):
        figures = got[18 * k : 18 * k + 18]
        found[c] = [(figures[j], (figures[j + 1], figures[j + 2])) for j in range(0, 18, 3) if figures[j]]
    return found


def _select(values: DataFrame, regions: dict, wanted: set[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The value of each wanted (column, rank)."""
    found: dict[tuple[str, int], float] = {}
    open_ranges: dict[_Range, list[int]] = {}

    def go_on(column: str, rank: int, parts, below: int) -> None:
        """Into the part that holds the rank."""
        for rows, (low, high) in parts:
            if rank < below + rows:
                if low == high or math.isnan(low):
                    found[column, rank] = low + 0.0
                else:
                    open_ranges.setdefault(_Range(column, low, high, below), []).append(rank)
                return
            below += rows
        raise LookupError(f"{column} has no rank {rank}: its rows changed while they were counted")

    for column, rank in sorted(wanted):
        go_on(column, rank, regions[column], 0)
    while open_ranges:
        ranges, open_ranges = list(open_ranges.items()), {}
        entries = [
            F.struct(F.lit(k).alias("k"), r.bucket().alias("part"), F.col(f"`{r.column}`").alias("value"))
            for k, (r, _) in enumerate(ranges)
        ]
        counted = (
            values.select(F.explode(F.array(*entries)).alias("e"))
            .select("e.*")
            .filter(F.col("part").isNotNull())
            .groupBy("k", "part")
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        )
        parts: dict[int, list] = {}
        for row in sorted(counted.collect(), key=lambda r: (r.k, r.part)):
            parts.setdefault(row.k, []).append((row.n, (row.low, row.high)))
        for k, (r, ranks) in enumerate(ranges):
            for rank in ranks:
                go_on(r.column, rank, parts.get(k, []), r.below)
    return found
