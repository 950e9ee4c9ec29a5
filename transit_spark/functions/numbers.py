"""Rounding and averages with one meaning on every plan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key_round(value: Column, places: int = 2) -> Column:
    """Half-up rounding for join keys; the added zero turns -0.0 into 0.0."""
    return F.round(value, places) + F.lit(0.0)


def report_round(value: Column, places: int) -> Column:
    """Half-even rounding for reported predictions."""
    return F.bround(value, places)


def exact_mean(value: Column) -> Column:
    """Average as one division of the sum by the count.

    For whole-number and decimal columns the sum is exact, so the result does
    not depend on how the rows were split over tasks.
    """
    return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))
