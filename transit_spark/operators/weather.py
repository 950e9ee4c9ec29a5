"""Weather: standard columns, stations by rounded coordinates, back-fill onto facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from transit_spark.fixed_values import COVERAGE_STATIONS
from transit_spark.functions.calendar import date_from_day_first
from transit_spark.functions.numbers import exact_mean, key_round
from transit_spark.functions.weather import weather_risk
from transit_spark.operators.joins import join_counted

MEASURES = ("weather_code", "precipitation_mm", "weather_risk_score")

CSV_NAMES = {
    "Date": "weather_date",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "weather_code (wmo code)": "weather_code",
    "precipitation_sum (mm)": "precipitation_mm",
}


def standardise_weather(raw: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Raw weather columns to standard names, a real date and a risk score."""
    return raw.withColumnsRenamed(names or CSV_NAMES).withColumns(
        {
            "weather_date": date_from_day_first(F.col("weather_date")),
            "weather_risk_score": weather_risk(F.col("weather_code")),
        }
    )


def station_cells(stations: DataFrame, places: int = 2) -> DataFrame:
    """One station per rounded point: the one nearest to the point, the first code among equals."""
    lat, lon = key_round(F.col("latitude"), places), key_round(F.col("longitude"), places)
    north, east = F.col("latitude") - lat, F.col("longitude") - lon
    nearest = F.min(F.struct((north * north + east * east).alias("away"), "station_code", "station_name"))
    cells = stations.groupBy(lat.alias("__lat"), lon.alias("__lon")).agg(nearest.alias("s"))
    return cells.select("__lat", "__lon", "s.station_code", "s.station_name")


def attach_stations(weather: DataFrame, stations: DataFrame, places: int = 2, matches: str = "nearest") -> DataFrame:
    """Left join to the station whose coordinates round to the same point.

    Stations are first reduced to one per point, so the result is as long as the weather, however many stations and
    weather rows share a point. ``matches="all"`` keeps every pair of a point.
    """
    if matches not in ("nearest", "all"):
        raise ValueError("matches must be 'nearest' or 'all'")
    keys = {
        "__lat": key_round(F.col("latitude"), places),
        "__lon": key_round(F.col("longitude"), places),
    }
    if matches == "nearest":
        return join_counted(weather.withColumns(keys), station_cells(stations, places), list(keys)).drop(*keys)
    points = stations.withColumns(keys).select("station_code", "station_name", *keys)
    return weather.withColumns(keys).join(points, list(keys), "left").drop(*keys)


def daily_weather(weather: DataFrame, matched_only: bool = False) -> DataFrame:
    """Average of each measure per date; over all weather rows unless ``matched_only``."""
    if matched_only:
        weather = weather.filter(F.col("station_code").isNotNull())
    return weather.groupBy("weather_date").agg(
        *[exact_mean(F.col(m)).alias(f"avg_{m}") for m in MEASURES]
    )


def mean_per_station_day(weather: DataFrame) -> DataFrame:
    """One weather row per station and date, so that the join keeps the number of facts."""
    return weather.groupBy("station_code", "weather_date").agg(
        *[exact_mean(F.col(m)).alias(m) for m in MEASURES]
    )


def backfill_weather(
    facts: DataFrame,
    weather: DataFrame,
    station: str = "station",
    date: str = "travel_date",
    dedupe: str | None = "mean",
    matched_only: bool = False,
) -> DataFrame:
    """Weather of the station and date, else the average of the date, else 0.

    Several weather rows for one station and date are averaged first, so the result
    is as long as the facts; with ``dedupe=None`` each of them repeats the fact.
    """
    if dedupe not in (None, "mean"):
        raise ValueError("dedupe must be None or 'mean'")
    weather = weather.select("station_code", "weather_date", *MEASURES)
    local = mean_per_station_day(weather) if dedupe else weather
    local = local.withColumnsRenamed({"station_code": station, "weather_date": date})
    # A row without a station or date can match nothing; without it, AQE has no NULL key to skew on.
    local = local.filter(F.col(station).isNotNull() & F.col(date).isNotNull())
    daily = daily_weather(weather, matched_only).withColumnRenamed("weather_date", date)
    joined = join_counted(facts.join(local, [station, date], "left"), daily, date)
    filled = {
        m: F.coalesce(F.col(m).cast("double"), F.col(f"avg_{m}"), F.lit(0.0)) for m in MEASURES
    }
    return joined.select(*facts.columns, *[c.alias(m) for m, c in filled.items()])


def station_coverage(weather: DataFrame, stations: Sequence[str] = COVERAGE_STATIONS) -> DataFrame:
    """Rows and date range of the weather per listed station."""
    return (
        weather.filter(F.col("station_code").isin(list(stations)))
        .groupBy("station_code")
        .agg(
            F.count(F.lit(1)).alias("weather_records"),
            F.min("weather_date").alias("from_date"),
            F.max("weather_date").alias("to_date"),
        )
        .orderBy("station_code")
    )


def match_coverage(df: DataFrame, key: str) -> DataFrame:
    """Total, matched and unmatched rows in one pass, with the matched share in percent."""
    total, matched = F.count(F.lit(1)), F.count(key)
    return df.agg(
        total.alias("total_rows"),
        matched.alias("matched_rows"),
        (total - matched).alias("unmatched_rows"),
        F.round(matched * 100 / F.nullif(total, F.lit(0)), 1).alias("matched_percent"),
    )
