"""Renaming and small projections."""

from __future__ import annotations

from pyspark.sql import DataFrame


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def underscore_names(df: DataFrame) -> DataFrame:
    """Spaces in column names become underscores, in one projection."""
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows of a stated order, so that a preview shows the same rows every time."""
    return df.orderBy(*order).limit(n)
