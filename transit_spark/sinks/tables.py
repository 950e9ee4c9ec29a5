"""Managed, path and external tables, CSV and JSON documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def _writer(df: DataFrame, partition_by: str | None):
    if partition_by is None:
        return df.write.mode("overwrite")
    # Rebalancing gathers each partition value into few files; adaptive execution cuts
    # a value that holds much of the data into several tasks.
    return df.hint("rebalance", F.col(partition_by)).write.mode("overwrite").partitionBy(partition_by)


def publish_table(df: DataFrame, name: str, partition_by: str | None = None) -> None:
    """Replace a managed table, its schema included. ``df`` must not read that table."""
    _writer(df, partition_by).format("parquet").saveAsTable(name)


def publish_path(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace a parquet folder. ``df`` must not read that folder; see ``snapshots`` for that."""
    _writer(df, partition_by).parquet(path)


def replace_dates(df: DataFrame, path: str, partition_by: str = "travel_date") -> None:
    """Replace only the partitions that ``df`` has rows for; those of other dates keep their files.

    A rerun with the same rows leaves the same table. ``df`` must not read that folder. The columns have to be those
    of the folder.
    """
    _writer(df, partition_by).option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_table_dates(df: DataFrame, name: str, partition_by: str = "travel_date") -> None:
    """The same for a managed table, which is made if it is not there."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        publish_table(df, name, partition_by)
        return
    table = spark.table(name)
    if set(table.columns) != set(df.columns):
        raise ValueError(f"columns of {name} are {table.columns}, not {df.columns}")
    mode = "spark.sql.sources.partitionOverwriteMode"  # an insert takes it from the session alone
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        df.select(*table.columns).hint("rebalance", F.col(partition_by)).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)


def append_path(df: DataFrame, path: str) -> None:
    """Add rows to a parquet folder, such as a metric log."""
    df.write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """A folder written by ``append_new``: one row per key, none before the first append.

    Two writers that append the same key at the same time may both write it; readers see the smallest of such rows.
    """
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__rest")).select(*keys, "__rest.*").select(*rows.columns)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Add the rows whose key the folder does not have yet, so that a rerun adds nothing."""
    there = read_appended(df.sparkSession, path, df.schema, keys).select(*keys)
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(there[k]) for k in keys])
    append_path(df.dropDuplicates(list(keys)).join(there, same, "left_anti"), path)


def register_external(spark: SparkSession, name: str, path: str) -> None:
    """Name an existing parquet folder in the catalog; an existing table of that name stays."""
    quoted = ".".join(f"`{part}`" for part in name.replace("`", "").split("."))
    location = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted} USING parquet LOCATION '{location}'")


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with header lines, written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_documents(documents: DataFrame, path: str, column: str = "document") -> None:
    """One JSON document per line."""
    documents.select(column).write.mode("overwrite").text(path)
