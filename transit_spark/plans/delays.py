"""Delay facts from documents to enriched history, and scoring of requests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from transit_spark.fixed_values import HOLIDAYS, MAINTENANCE_MINUTES
from transit_spark.functions import messages
from transit_spark.functions.calendar import calendar_parts, day_type
from transit_spark.functions.delays import delay_category
from transit_spark.functions.numbers import report_round
from transit_spark.operators.history import add_maintenance_flag, add_rolling_delay
from transit_spark.operators.joins import counted, join_counted
from transit_spark.operators.lookups import lookup_stops, split_requests
from transit_spark.operators.weather import backfill_weather
from transit_spark.sinks.snapshots import publish_snapshot
from transit_spark.sources.delay_documents import delay_facts

# Feature columns of the delay model, in order.
FEATURES = (
    "train_number",
    "station_enc",
    "month",
    "day",
    "day_of_week",
    "week",
    "day_type",
    "rolling_72hr_avg_delay",
    "is_maintenance_likely",
    "weather_code",
    "precipitation_mm",
    "weather_risk_score",
)


def enrich_facts(
    facts: DataFrame,
    threshold: float = MAINTENANCE_MINUTES,
    holidays: Sequence[dt.date] = HOLIDAYS,
) -> DataFrame:
    """Day type, rolling delay and maintenance flag."""
    with_day = facts.withColumn("day_type", day_type(F.col("travel_date"), holidays))
    return add_maintenance_flag(add_rolling_delay(with_day), threshold=threshold)


def build_delay_facts(documents: DataFrame, weather: DataFrame, root: str, view: str) -> DataFrame:
    """Documents and weather to the enriched fact table, one published version per step."""
    spark = documents.sparkSession
    publish_snapshot(delay_facts(documents), root, view, "travel_date", "INGEST")
    publish_snapshot(enrich_facts(spark.table(view)), root, view, "travel_date", "ENRICH")
    return publish_snapshot(backfill_weather(spark.table(view), weather), root, view, "travel_date", "WEATHER")


def request_features(
    requests: DataFrame,
    lookup: DataFrame,
    station_codes: DataFrame | None = None,
    holidays: Sequence[dt.date] = HOLIDAYS,
    defaults: dict[str, float] | None = None,
) -> DataFrame:
    """Feature rows, one per stop, for requests ``(train_number, travel_date)``.

    Calendar features are computed per request, before the stops multiply the rows.
    """
    date = F.col("travel_date")
    dated = requests.withColumns({**calendar_parts(date), "day_type": day_type(date, holidays)})
    stops = lookup_stops(dated, lookup, defaults)
    if station_codes is not None:
        stops = join_counted(stops, station_codes, "station")
    return stops


def score_delays(features: DataFrame, model=None) -> DataFrame:
    """Predicted delay, half-even to one decimal, and its category.

    ``model`` is any fitted Spark ML regression pipeline on the features; without
    one the historical rolling average is the prediction.
    """
    if model is None:
        raw = features.withColumn("prediction", F.col("rolling_72hr_avg_delay"))
    else:
        raw = model.transform(features)
    minutes = report_round(F.col("prediction"), 1)
    return raw.withColumn("predicted_delay_min", minutes).withColumn(
        "delay_category", delay_category(F.col("predicted_delay_min"))
    )


def score_request_table(
    requests: DataFrame,
    lookup: DataFrame,
    station_codes: DataFrame,
    model,
    holidays: Sequence[dt.date] = HOLIDAYS,
) -> tuple[DataFrame, DataFrame]:
    """Scored stops, and one error row for every request that cannot be scored.

    Each distinct ``(train_number, travel_date)`` is answered once. The stops of its train come from ``lookup`` with
    their averages, the codes from the table that the model was trained with. A train that the lookup does not have,
    or with a station that has no code, gives an error row instead of stops.
    """
    asked = requests.select("train_number", "travel_date").distinct()
    known, unknown = split_requests(asked, lookup)
    encoded, uncoded = split_encoded(request_features(known, lookup, station_codes, holidays))
    return score_delays(encoded, model), unknown.unionByName(uncoded)


def result_documents(scored: DataFrame, errors: DataFrame) -> DataFrame:
    """One JSON document per train and date: its stops by name, or the error.

    Stops are gathered as a set, which repeated requests do not enlarge: a
    document is as long as the train's route.
    """
    stamp = F.date_format("travel_date", "yyyy-MM-dd HH:mm:ss")
    stop = F.struct("station", "predicted_delay_min", "delay_category")
    grouped = (
        scored.groupBy("train_number", "travel_date")
        .agg(F.array_sort(F.collect_set(stop)).alias("stops"))
        .withColumn("error", F.lit(None).cast("string"))
    )
    failed = errors.select(
        "train_number",
        "travel_date",
        F.array().cast(grouped.schema["stops"].dataType).alias("stops"),
        "error",
    ).distinct()
    body = F.struct("train_number", stamp.alias("prediction_date"), "stops", "error")
    return grouped.unionByName(failed).select(
        "train_number", "travel_date", F.to_json(body, {"ignoreNullFields": "false"}).alias("document")
    )


def split_encoded(features: DataFrame, code: str = "station_enc") -> tuple[DataFrame, DataFrame]:
    """Feature rows of trains whose stations all have a code, and one error row per request of the others."""
    keys = ["train_number", "travel_date"]
    failed = counted(features.filter(F.col(code).isNull()).select(*keys).distinct())
    errors = failed.withColumn("error", messages.encoding_failed(F.col("train_number")))
    return features.join(failed, keys, "left_anti"), errors


def prediction_rows(scored: DataFrame) -> DataFrame:
    """The stored form of predictions."""
    return scored.select(
        "station", "predicted_delay_min", "train_number", F.col("travel_date").cast("string").alias("query_date")
    )
