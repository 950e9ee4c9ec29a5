"""Predictions against scraped actual delays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from transit_spark.functions.delays import delay_minutes
from transit_spark.functions.numbers import exact_mean

KEYS = ("train_number", "station")


def actual_delays(*days: DataFrame) -> DataFrame:
    """Parsed delays of the day files, averaged per train and station.

    A station may be listed twice for a train, and each file is one day.
    """
    together = reduce(DataFrame.unionByName, days)
    return (
        together.select(*KEYS, delay_minutes(F.col("delay")).alias("minutes"))
        .groupBy(*KEYS)
        .agg(exact_mean(F.col("minutes")).alias("actual_delay_min"), F.count("minutes").alias("n_actual"))
        .filter("n_actual > 0")
    )


def prediction_vs_actual(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predicted and actual delay side by side with the error."""
    error = F.col("predicted_delay_min") - F.col("actual_delay_min")
    return predictions.join(actuals, list(KEYS)).select(
        *KEYS, "predicted_delay_min", "actual_delay_min", "n_actual", error.alias("error_min"), F.abs(error).alias("abs_error_min")
    )
