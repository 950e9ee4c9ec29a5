"""Running totals and codes over a total order, without one task seeing it all.

A window without partition keys, or with a hot one, sorts its whole group in one
task. Groups of ordinary size get that plain window. The rows of larger groups, or
of a whole table, are range-partitioned by (group, order), each range is totalled,
the totals are accumulated (one row per range), and every range then runs its own
window from its offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from transit_spark.operators.joins import counted
from transit_spark.session import is_staged, stage

# Rows of one group that one task may sort.
GROUP_ROWS = 10_000_000

_RANGE, _BASE = "__range", "__base"


def running_sum(
    df: DataFrame,
    order: Sequence[str],
    values: dict[str, Column],
    groups: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add inclusive running totals ``{name: value}`` along ``order`` within ``groups``.

    ``groups`` and ``order`` together must identify a row, so that ranges can be
    cut between any two rows.
    """
    groups, order = list(groups), list(order)
    steps = {f"__step_{name}": value for name, value in values.items()}
    result = [*df.columns, *values]
    if not groups:
        return _by_ranges(df.withColumns(steps), order, values, groups).select(*result)

    # Read for the sizes, the ordinary groups and the large ones; computed once.
    rows = df if is_staged(df) else stage(df)
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows"))
    large = stage(sizes.filter(F.col("__rows") > group_rows).select(*[F.col(g).alias(f"__large_{g}") for g in groups]))
    rows = rows.withColumns(steps)
    if large.isEmpty():
        return _by_group(rows, order, values, groups).select(*result)
    large = counted(large)
    is_large = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__large_{g}")) for g in groups])
    ordinary = _by_group(rows.join(large, is_large, "left_anti"), order, values, groups)
    split = _by_ranges(rows.join(large, is_large, "left_semi"), order, values, groups)
    return ordinary.select(*result).unionByName(split.select(*result))


def _by_group(rows: DataFrame, order: list[str], values: dict[str, Column], groups: list[str]) -> DataFrame:
    window = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({name: F.sum(f"__step_{name}").over(window) for name in values})


def _by_ranges(rows: DataFrame, order: list[str], values: dict[str, Column], groups: list[str]) -> DataFrame:
    ranged = stage(rows.repartitionByRange(*groups, *order).withColumn(_RANGE, F.spark_partition_id()))

    steps = [f"__step_{name}" for name in values]
    totals = ranged.groupBy(*groups, _RANGE).agg(*[F.sum(s).alias(s) for s in steps])
    by_range = Window.partitionBy(*groups).orderBy(_RANGE)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"__key_{g}") for g in groups],
        F.col(_RANGE).alias("__key_range"),
        F.row_number().over(by_range).alias("__nth"),
        *[F.sum(s).over(before).alias(f"{_BASE}{s}") for s in steps],
    ).filter("__nth > 1")
    # A group has an offset row only for a range it does not start in, so there are
    # fewer offset rows than ranges: safe to broadcast whatever the data.
    same = F.col(_RANGE) == F.col("__key_range")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__key_{g}"))
    placed = ranged.join(F.broadcast(offsets), same, "left")

    within = (
        Window.partitionBy(*groups, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return placed.withColumns(
        {
            name: F.coalesce(F.col(f"{_BASE}__step_{name}"), F.lit(0)) + F.sum(f"__step_{name}").over(within)
            for name in values
        }
    )


def dense_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Each distinct non-NULL value of ``column`` with its 0-based place in ascending order."""
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked = running_sum(distinct, [column], {"__place": F.lit(1).cast("bigint")})
    return ranked.select(column, (F.col("__place") - 1).cast("int").alias(code))
