"""Codes, imputation, scaling and splits as plain relational operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from transit_spark.operators.joins import join_counted, with_global
from transit_spark.operators.ordered import dense_codes, running_sum
from transit_spark.operators.percentiles import percentiles
from transit_spark.session import stage


def label_encode(df: DataFrame, column: str, code: str) -> DataFrame:
    """Add the place of each value among the sorted distinct values."""
    return join_counted(df, dense_codes(df, column, code), column)


def frequency_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Distinct values coded by falling frequency, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(
        counts.withColumn("__minus", -F.col("n")), ["__minus", column], {"__place": F.lit(1).cast("bigint")}
    )
    return ranked.select(column, "n", (F.col("__place") - 1).cast("int").alias(code))


def frequency_index(df: DataFrame, column: str, code: str) -> DataFrame:
    """Add the frequency code; unseen and NULL values get the next free code."""
    codes = stage(frequency_codes(df, column, code).drop("n"))
    size = codes.agg(F.count(F.lit(1)).cast("int").alias("__unseen"))
    coded = with_global(join_counted(df, codes, column), size)
    return coded.withColumn(code, F.coalesce(code, "__unseen")).drop("__unseen")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians, one row per column."""
    return percentiles(df, columns, {"median": 0.5})


def median_impute(df: DataFrame, columns: Sequence[str], suffix: str = "_imp") -> DataFrame:
    """Add each column as double with NULLs replaced by its median."""
    wide = medians(df, columns).agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns]
    )
    filled = with_global(df, wide, "__median_")
    return filled.select(
        *df.columns,
        *[F.coalesce(F.col(f"`{c}`").cast("double"), f"__median_{c}").alias(f"{c}{suffix}") for c in columns],
    )


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_std") -> DataFrame:
    """Add each column with mean 0 and sample standard deviation 1; a constant column becomes 0."""
    moments = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns]
    )
    both = with_global(df, moments, "__")

    def scaled(c: str) -> Column:
        sd = F.col(f"__sd_{c}")
        return F.when(sd > 0, (F.col(c) - F.col(f"__mean_{c}")) / sd).when(F.col(c).isNotNull(), 0.0)

    return both.select(*df.columns, *[scaled(c).alias(f"{c}{suffix}") for c in columns])


#: Column that names the fold of a training row.
FOLD = "fold"


def hash_bucket(*keys: str) -> Column:
    """0 to 99 from the md5 of the key text: the same on every run and every cluster."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100


def hash_split(df: DataFrame, *keys: str, train_percent: int = 80, bucket: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, decided by the key alone; ``bucket`` names a column that has its ``hash_bucket``."""
    train = (F.col(bucket) if bucket else hash_bucket(*keys)) < train_percent
    return df.filter(train), df.filter(~train)


def bounded_rows(df: DataFrame, rows: int) -> DataFrame:
    """At most so many rows, chosen by the hash of their content: the same ones on every run and every cluster."""
    order = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.orderBy(order, *[F.col(f"`{c}`") for c in df.columns]).limit(rows)
