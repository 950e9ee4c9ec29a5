"""Lookup tables per train and station, and requests against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from transit_spark.functions import messages
from transit_spark.functions.numbers import exact_mean
from transit_spark.operators.joins import counted, join_counted

PAIR = ("train_number", "station")
LOOKUP_MEANS = ("rolling_72hr_avg_delay", "weather_code", "precipitation_mm", "weather_risk_score")


def station_lookup(
    facts: DataFrame,
    means: Sequence[str] = LOOKUP_MEANS,
    flags: Sequence[str] = ("is_maintenance_likely",),
    latest: str | None = None,
    date: str = "travel_date",
) -> DataFrame:
    """One row per train and station: averages of ``means``, maxima of ``flags``.

    ``latest`` names one of the means to take from the newest date instead.
    """
    measures = [
        (F.max_by(m, date) if m == latest else exact_mean(F.col(m))).alias(m) for m in means
    ]
    return facts.groupBy(*PAIR).agg(*measures, *[F.max(f).alias(f) for f in flags])


def distinct_pairs(facts: DataFrame, train: int | None = None) -> DataFrame:
    """Distinct train and station pairs, of one train if given."""
    if train is not None:
        facts = facts.filter(F.col("train_number") == train)
    return facts.select(*PAIR).distinct()


def network_size(facts: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of trains and stations."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return facts.agg(count("train_number").alias("n_trains"), count("station").alias("n_stations"))


def split_requests(requests: DataFrame, known: DataFrame, key: str = "train_number") -> tuple[DataFrame, DataFrame]:
    """Requests whose key is known, and error rows for the others."""
    keys = counted(known.select(key).distinct())
    valid = requests.join(keys, key, "left_semi")
    errors = requests.join(keys, key, "left_anti").withColumn("error", messages.unknown_train(F.col(key)))
    return valid, errors


def lookup_stops(
    requests: DataFrame, lookup: DataFrame, defaults: dict[str, float] | None = None
) -> DataFrame:
    """One row per request and stop of its train.

    NULL features become the defaults, 0 unless given; a default for a column the
    lookup does not have adds it, so a table of bare pairs will do.
    """
    defaults = defaults or {}
    features = [c for c in lookup.columns if c not in PAIR]
    stops = join_counted(requests, lookup, "train_number", "inner")
    filled = stops.fillna({c: defaults.get(c, 0) for c in features}) if features else stops
    return filled.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in lookup.columns})


def stop_lookup(requests: DataFrame, scored: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Answer text for requests ``(request_id, train_number, station, travel_date)``.

    ``scored`` holds ``(train_number, travel_date, station, predicted_delay_min)``.
    ``known`` lists the known trains, such as the lookup table; by default they
    are those that ``scored`` holds. Every request has one answer: a stop scored
    more than once answers with its smallest prediction.
    """
    stop = ["train_number", "travel_date", "station"]
    trains = (scored if known is None else known).select("train_number").distinct().withColumn("__known", F.lit(True))
    minutes = scored.groupBy(*stop).agg(F.min("predicted_delay_min").alias("predicted_delay_min"))
    matched = requests.join(minutes, stop, "left")
    matched = join_counted(matched, trains, "train_number")
    train, station, minutes = F.col("train_number"), F.col("station"), F.col("predicted_delay_min")
    answer = (
        F.when(F.col("__known").isNull(), F.concat(F.lit("Error: "), messages.unknown_train(train)))
        .when(minutes.isNull(), messages.stop_missing(station, train))
        .otherwise(messages.stop_delay(station, minutes))
    )
    return matched.select(*requests.columns, "predicted_delay_min", answer.alias("answer"))


def waiting_list_average(waiting_list: DataFrame) -> DataFrame:
    """Average waiting list and its text for every source station and train."""
    average = F.col("avg_waiting")
    return (
        waiting_list.groupBy("source_station", "train_number")
        .agg(exact_mean(F.col("waiting_list")).alias("avg_waiting"))
        .withColumn("answer", messages.waiting_list(average))
    )


def answer_waiting_list(requests: DataFrame, waiting_list: DataFrame) -> DataFrame:
    """The same text for requests; a pair without rows answers N/A."""
    averages = waiting_list_average(waiting_list).drop("answer")
    found = join_counted(requests, averages, ["source_station", "train_number"])
    return found.withColumn("answer", messages.waiting_list(F.col("avg_waiting")))


ROUTE_KEYS = ("source_station", "destination_station", "scheduled_departure")


def find_routes(requests: DataFrame, schedule: DataFrame) -> DataFrame:
    """The schedule rows that answer each distinct question, or one row saying that there is none.

    A question asked a million times is answered once, so the result never holds
    pairs of requests and schedule rows. The semi join lets adaptive execution
    split a hot question on the schedule side.
    """
    keys = list(ROUTE_KEYS)
    questions = requests.select(*keys).distinct()
    line = messages.route_line(F.col("train_number"), F.col("source_station"), F.col("destination_station"))
    found = schedule.select(*keys, "train_number").join(questions, keys, "left_semi")
    missing = questions.join(schedule.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(None).cast(schedule.schema["train_number"].dataType).alias("train_number")
    )
    return found.withColumn("answer", line).unionByName(missing.withColumn("answer", F.lit(messages.NO_ROUTE)))


def answer_routes(requests: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per request ``(request_id, source_station, destination_station, scheduled_departure)`` with its answer.

    The answer lists every train of the schedule at that departure, by number, or says that there is none. It is made
    once for each distinct question, from the trains of one departure, and then joined to the requests, so the result
    is as long as the requests; a question that very many ask is split by adaptive execution.
    """
    keys = list(ROUTE_KEYS)
    found = find_routes(requests, schedule).filter(F.col("train_number").isNotNull())
    lines = F.sort_array(F.collect_list(F.struct("train_number", "answer")))
    answers = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_routes"), lines.alias("lines")).select(
        *keys, "n_routes", messages.possible_routes(F.col("lines.answer")).alias("answer")
    )
    joined = join_counted(requests.select("request_id", *keys), answers, keys)
    return joined.select(
        "request_id",
        *keys,
        F.coalesce("n_routes", F.lit(0).cast("bigint")).alias("n_routes"),
        F.coalesce("answer", F.lit(messages.NO_ROUTE)).alias("answer"),
    )


def run_sql(spark: SparkSession, text: str, **args) -> DataFrame:
    """SQL with named parameters; values never become part of the text."""
    return spark.sql(text, args=args)
