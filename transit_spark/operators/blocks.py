"""Blocks between marker rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from transit_spark.fixed_values import COMPLETE_BLOCKS, MISSING_TEXT
from transit_spark.operators.ordered import running_sum


def run_blocks(
    rows: DataFrame, group: str, position: str, marker: Column, block: str = "run_block"
) -> DataFrame:
    """Number of marker rows up to and including each row, counted within ``group``."""
    step = F.when(marker, 1).otherwise(0).cast("bigint")
    return running_sum(rows, [position], {block: step}, [group])


def divider(name: str = "station_name", delay: str = "delay") -> Column:
    return (F.col(name) == MISSING_TEXT) & (F.col(delay) == MISSING_TEXT)


def keep_blocks(
    rows: DataFrame, blocks: Sequence[int] = COMPLETE_BLOCKS, block: str = "run_block", name: str = "station_name"
) -> DataFrame:
    """Rows of the chosen blocks without the rows that have no name."""
    return rows.filter(F.col(block).isin(list(blocks)) & (F.col(name) != MISSING_TEXT))
