"""Rolling delay history per station."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from transit_spark.fixed_values import HISTORY_DAYS, MAINTENANCE_MINUTES
from transit_spark.functions.delays import maintenance_flag
from transit_spark.operators.joins import join_counted


def station_day_totals(
    facts: DataFrame, station: str = "station", date: str = "travel_date", delay: str = "delay_min"
) -> DataFrame:
    """Sum and count of the known delays per station and day; partial sums are combined before the shuffle."""
    return facts.groupBy(station, date).agg(
        F.sum(delay).alias("delay_sum"), F.count(delay).alias("delay_count")
    )


def station_day_history(
    facts: DataFrame,
    station: str = "station",
    date: str = "travel_date",
    delay: str = "delay_min",
    days: int = HISTORY_DAYS,
    rolling: str = "rolling_72hr_avg_delay",
) -> DataFrame:
    """Average over the ``days`` days before each day of a station, all trains pooled.

    The window runs over daily totals, so a station contributes one row per day
    no matter how many facts it owns. NULL where the frame holds no known delay.
    """
    frame = Window.partitionBy(station).orderBy(F.unix_date(date)).rangeBetween(-days, -1)
    known = F.sum("delay_count").over(frame)
    return station_day_totals(facts, station, date, delay).select(
        station,
        date,
        (F.sum("delay_sum").over(frame).cast("double") / F.nullif(known, F.lit(0))).alias(rolling),
        F.coalesce(known, F.lit(0)).cast("bigint").alias("history_count"),
    )


def add_rolling_delay(
    facts: DataFrame,
    station: str = "station",
    date: str = "travel_date",
    delay: str = "delay_min",
    days: int = HISTORY_DAYS,
    rolling: str = "rolling_72hr_avg_delay",
    keep_history_count: bool = False,
) -> DataFrame:
    """Add the rolling average to every fact; 0 where there is no history."""
    history = station_day_history(facts, station, date, delay, days, rolling)
    if not keep_history_count:
        history = history.drop("history_count")
    joined = join_counted(facts, history, [station, date])
    return joined.withColumn(rolling, F.coalesce(rolling, F.lit(0.0)))


def add_maintenance_flag(
    facts: DataFrame,
    rolling: str = "rolling_72hr_avg_delay",
    threshold: float = MAINTENANCE_MINUTES,
    flag: str = "is_maintenance_likely",
) -> DataFrame:
    return facts.withColumn(flag, maintenance_flag(F.col(rolling), threshold))
