"""Joins that broadcast only what has been counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from transit_spark.session import is_staged, stage

# Largest table to broadcast, in rows and in bytes of its files.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def counted(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Stage a table that is usually small and mark it for broadcast if its real size is within both bounds.

    The optimizer estimates an aggregate by the size of its input, so it would
    shuffle the large side of a join to it. The staged table has known contents;
    counting reads no columns. Above the bounds there is no mark, both sides of
    the join are shuffled, and adaptive execution splits hot keys.
    """
    staged = small if is_staged(small) else stage(small)
    files = staged.groupBy("_metadata.file_path").agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )
    size = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return F.broadcast(staged) if size.rows <= max_rows and size.bytes <= max_bytes else staged


def join_counted(
    left: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``left`` to a table that is usually small, such as an aggregate of ``left`` itself."""
    return left.join(counted(small, max_rows), on, how)


def with_global(df: DataFrame, one_row: DataFrame, prefix: str = "") -> DataFrame:
    """Add the columns of a one-row aggregate as constants, through a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("all"))
    with_struct = df.withColumn("__global", packed.scalar())
    return with_struct.select(
        *df.columns, *[F.col(f"__global.`{c}`").alias(f"{prefix}{c}") for c in one_row.columns]
    )
