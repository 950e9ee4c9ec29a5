"""Weather scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from transit_spark.fixed_values import DEFAULT_WEATHER_RISK, WEATHER_RISK


def weather_risk(code: Column) -> Column:
    """Risk score 0 to 4 of a WMO code; unlisted codes and NULL get the default."""
    result = None
    for score, codes in WEATHER_RISK.items():
        match = code.isin(codes)
        result = F.when(match, score) if result is None else result.when(match, score)
    return result.otherwise(DEFAULT_WEATHER_RISK)
