"""Catalog and path tables, and small request tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession,
    name: str,
    columns: Sequence[str] | None = None,
    date_column: str = "travel_date",
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
) -> DataFrame:
    """A catalog table, pruned to columns and to a date range (both ends included)."""
    return _prune(spark.table(name), columns, date_column, date_from, date_to)


def read_path(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    date_column: str = "travel_date",
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
) -> DataFrame:
    """The same for a parquet folder."""
    return _prune(spark.read.parquet(path), columns, date_column, date_from, date_to)


def requests_from_rows(spark: SparkSession, rows, schema: StructType | str) -> DataFrame:
    """A table from a few rows, such as one user's question: tuples, dictionaries or a pandas frame."""
    return spark.createDataFrame(rows, schema)


def _prune(df, columns, date_column, date_from, date_to):
    if date_from is not None:
        df = df.filter(F.col(date_column) >= F.lit(date_from))
    if date_to is not None:
        df = df.filter(F.col(date_column) <= F.lit(date_to))
    return df.select(*columns) if columns else df
