import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window, functions as F

from transit_spark import schemas
from transit_spark.catalog import delay_queries
from transit_spark.fixed_values import BARE_STOP_DEFAULTS
from transit_spark.operators.compare import actual_delays, prediction_vs_actual
from transit_spark.operators.history import add_maintenance_flag, add_rolling_delay
from transit_spark.operators.lookups import (
    answer_routes,
    answer_waiting_list,
    distinct_pairs,
    find_routes,
    network_size,
    run_sql,
    split_requests,
    station_lookup,
    stop_lookup,
)
from transit_spark.operators.ordered import dense_codes
from transit_spark.operators.weather import (
    attach_stations,
    backfill_weather,
    daily_weather,
    match_coverage,
    standardise_weather,
    station_coverage,
)
from transit_spark.plans.delays import (
    build_delay_facts,
    enrich_facts,
    prediction_rows,
    request_features,
    result_documents,
    score_delays,
    split_encoded,
)
from transit_spark.sinks.snapshots import history

FACTS = "train_number INT, station STRING, travel_date DATE, delay_min INT"


def d(day, month=1, year=2025):
    return dt.date(year, month, day)


def test_rolling_by_hand(spark, rows):
    df = spark.createDataFrame(
        [(1, "A", d(1), 10), (2, "A", d(1), 20), (1, "A", d(3), None), (1, "A", d(5), 40), (1, "A", d(9), 1)], FACTS
    )
    got = rows(add_rolling_delay(df, keep_history_count=True), "travel_date", "rolling_72hr_avg_delay", "history_count")
    assert got == [
        (d(1), 0.0, 0),
        (d(1), 0.0, 0),
        (d(3), 15.0, 2),
        (d(5), 0.0, 0),
        (d(9), 0.0, 0),
    ]


def test_rolling_equals_row_form_with_a_hot_station(spark, rows):
    rng = random.Random(3)
    data = [
        (rng.randint(1, 4), "HOT" if i % 3 else f"S{rng.randint(1, 20)}", d(1) + dt.timedelta(days=rng.randint(0, 40)),
         None if i % 11 == 0 else rng.randint(0, 200))
        for i in range(2000)
    ]
    df = spark.createDataFrame(data, FACTS)
    frame = Window.partitionBy("station").orderBy(F.unix_date("travel_date")).rangeBetween(-3, -1)
    row_form = df.withColumn("r", F.coalesce(F.avg("delay_min").over(frame), F.lit(0.0)))
    columns = ["train_number", "station", "travel_date", "delay_min"]
    assert rows(add_rolling_delay(df, rolling="r"), *columns, "r") == rows(row_form, *columns, "r")


def test_maintenance_default_threshold(spark, rows):
    df = spark.createDataFrame([(15.0,), (15.01,)], "rolling_72hr_avg_delay DOUBLE")
    assert rows(add_maintenance_flag(df), "is_maintenance_likely") == [(0,), (1,)]


def weather_frame(spark, data):
    return spark.createDataFrame(
        data, "station_code STRING, weather_date DATE, weather_code INT, precipitation_mm DOUBLE, weather_risk_score INT"
    )


def test_backfill(spark, rows):
    facts = spark.createDataFrame(
        [(1, "A", d(1), 5), (1, "B", d(1), 5), (1, "C", d(2), 5)], FACTS
    )
    weather = weather_frame(
        spark, [("A", d(1), 61, 4.0, 3), ("A", d(1), 0, 2.0, 0), (None, d(1), 95, 9.0, 4), ("A", None, 1, 1.0, 1)]
    )
    columns = ["station", "weather_code", "precipitation_mm", "weather_risk_score"]
    assert rows(backfill_weather(facts, weather, dedupe=None), *columns) == [
        ("A", 0.0, 2.0, 0.0),
        ("A", 61.0, 4.0, 3.0),
        ("B", 52.0, 5.0, 7 / 3),
        ("C", 0.0, 0.0, 0.0),
    ]
    assert rows(backfill_weather(facts, weather), *columns) == [
        ("A", 30.5, 3.0, 1.5),
        ("B", 52.0, 5.0, 7 / 3),
        ("C", 0.0, 0.0, 0.0),
    ]
    assert rows(backfill_weather(facts, weather, matched_only=True).filter("station = 'B'"), *columns) == [("B", 30.5, 3.0, 1.5)]
    assert backfill_weather(facts.union(facts), weather.union(weather)).count() == 2 * facts.count()
    assert daily_weather(weather).count() == 2


def test_one_station_per_cell(spark, rows):
    weather = spark.range(10_000).selectExpr("id", "10.0 + id / 1e7D as latitude", "20.0D as longitude")
    stations = spark.range(500).selectExpr(
        "concat('S', id) as station_code", "concat('n', id) as station_name", "10.0 - (id + 1) / 1e6D as latitude", "20.0D as longitude"
    )
    twice = stations.union(spark.sql("SELECT 'S', 'n', 10.0D - 1 / 1e6D, 20.0D"))
    joined = attach_stations(weather, twice)
    assert joined.count() == 10_000 == joined.where("station_code = 'S'").count()
    assert joined.columns == ["id", "latitude", "longitude", "station_code", "station_name"]
    nothing = attach_stations(weather, stations.limit(0))
    assert nothing.count() == 10_000 and nothing.where("station_code is not null").count() == 0
    missing = spark.sql("SELECT 1 AS id, CAST(NULL AS DOUBLE) AS latitude, 20.0D AS longitude")
    assert rows(attach_stations(missing, missing.selectExpr("'X' AS station_code", "'x' AS station_name", "latitude", "longitude")), "station_code") == [(None,)]
    with pytest.raises(ValueError):
        attach_stations(weather, stations, matches="some")


def test_nearest_station_keeps_all_matches(spark, rows):
    weather = spark.createDataFrame([(1, 10.004, 20.0), (2, -0.001, 0.001), (3, 50.0, 50.0)], "i INT, latitude DOUBLE, longitude DOUBLE")
    stations = spark.createDataFrame(
        [("A", "a", 10.001, 20.003), ("B", "b", 9.996, 19.999), ("Z", "z", 0.0, 0.0)],
        "station_code STRING, station_name STRING, latitude DOUBLE, longitude DOUBLE",
    )
    assert rows(attach_stations(weather, stations), "i", "station_code") == [(1, "A"), (2, "Z"), (3, None)]
    joined = attach_stations(weather, stations, matches="all")
    assert rows(joined, "i", "station_code") == [(1, "A"), (1, "B"), (2, "Z"), (3, None)]
    assert rows(match_coverage(joined, "station_code")) == [(4, 3, 1, 75.0)]


def test_query_keeps_every_station_of_a_cell(spark, rows, tmp_path):
    points = [(0, [0.101, 0.202]), (2, [0.099, 0.198]), (1, [0.1, 0.2]), (3, [0.9, 0.9]), (5, None)]
    spark.createDataFrame(points, "vec_id BIGINT, embedding ARRAY<FLOAT>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rows(delay_queries.nearest_by_rounding(spark, str(tmp_path)), "vec_id", "station_code", "station_name")
    assert got == [(1, "S0", "Station S0"), (1, "S2", "Station S2"), (3, None, None), (5, None, None)]
    counts = rows(delay_queries.match_coverage_query(spark, str(tmp_path)), "total_rows", "matched_rows", "unmatched_rows")
    assert counts == [(3, 1, 2)]


def test_coverage_of_listed_stations(spark, rows):
    weather = weather_frame(spark, [("CBE", d(1), 1, 0.0, 1), ("CBE", d(3), 1, 0.0, 1), ("XX", d(1), 1, 0.0, 1)])
    assert rows(station_coverage(weather)) == [("CBE", 2, d(1), d(3))]


def test_lookup_and_pairs(spark, rows):
    facts = spark.createDataFrame(
        [(1, "A", d(1), 2.0, 0), (1, "A", d(2), 4.0, 1), (2, "B", d(1), None, 0)],
        "train_number INT, station STRING, travel_date DATE, r DOUBLE, is_maintenance_likely INT",
    )
    assert rows(station_lookup(facts, ["r"])) == [(1, "A", 3.0, 1), (2, "B", None, 0)]
    assert rows(station_lookup(facts, ["r"], latest="r"))[0] == (1, "A", 4.0, 1)
    assert rows(distinct_pairs(facts, train=1)) == [(1, "A")]
    assert rows(network_size(facts)) == [(2, 2)] == rows(network_size(facts, approximate=True))


def lookup_frame(spark):
    return spark.createDataFrame(
        [(1, "B", 61.0, 1), (1, "A", 0.25, 0), (2, "C", None, None)],
        "train_number INT, station STRING, rolling_72hr_avg_delay DOUBLE, is_maintenance_likely INT",
    )


def test_requests_to_documents(spark, rows):
    lookup = lookup_frame(spark)
    requests = spark.createDataFrame([(1, d(25)), (1, d(25)), (2, d(26)), (9, d(26)), (9, d(26))], schemas.DELAY_REQUESTS)
    valid, errors = split_requests(requests, lookup)
    scored = score_delays(request_features(valid, lookup, dense_codes(lookup, "station", "station_enc")))
    assert rows(scored.distinct(), "train_number", "station", "station_enc", "day_type", "predicted_delay_min", "delay_category") == [
        (1, "A", 0, 1, 0.2, "On Time"),
        (1, "B", 1, 1, 61.0, "Significant Delay"),
        (2, "C", 2, 2, 0.0, "On Time"),
    ]
    documents = [json.loads(r.document) for r in result_documents(scored, errors).orderBy("train_number").collect()]
    assert documents[0] == {
        "train_number": 1,
        "prediction_date": "2025-01-25 00:00:00",
        "stops": [
            {"station": "A", "predicted_delay_min": 0.2, "delay_category": "On Time"},
            {"station": "B", "predicted_delay_min": 61.0, "delay_category": "Significant Delay"},
        ],
        "error": None,
    }
    assert documents[2]["stops"] == [] and documents[2]["error"] == (
        "Train 9 not found. Please check the train number and try again."
    )
    assert len(documents) == 3
    assert rows(prediction_rows(scored).distinct())[0] == ("A", 0.2, 1, "2025-01-25")


def test_bare_pairs_and_missing_codes(spark, rows):
    pairs = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], schemas.STATION_PAIRS)
    requests = spark.createDataFrame([(1, d(26)), (2, d(26))], schemas.DELAY_REQUESTS)
    codes = spark.createDataFrame([("A", 0)], "station STRING, station_enc INT")
    features = request_features(requests, pairs, codes, holidays=[], defaults=BARE_STOP_DEFAULTS)
    valid, errors = split_encoded(features)
    assert rows(valid, "train_number", "station", "rolling_72hr_avg_delay", "is_maintenance_likely", "day_type") == [(2, "A", 15.0, 0, 1)]
    assert rows(errors, "train_number", "error") == [(1, "Station encoding failed for train 1.")]


def test_stop_lookup(spark, rows):
    scored = spark.createDataFrame(
        [(1, d(1), "A", 7.5)], "train_number INT, travel_date DATE, station STRING, predicted_delay_min DOUBLE"
    )
    requests = spark.createDataFrame(
        [(0, 1, "A", d(1)), (1, 1, "Q", d(1)), (2, 5, "A", d(1))],
        "request_id INT, train_number INT, station STRING, travel_date DATE",
    )
    again = spark.createDataFrame([(1, d(1), "A", 9.0), (1, d(1), "A", 7.5)], scored.schema)
    assert stop_lookup(requests, scored.union(again)).count() == 3
    assert [a for _, a in rows(stop_lookup(requests, scored.union(again)), "request_id", "answer")] == [
        "Predicted Delay at A: 7.50 minutes",
        "Station 'Q' not found in route for train 1",
        "Error: Train 5 not found. Please check the train number and try again.",
    ]


def test_app_lookups(spark, rows):
    waiting = spark.createDataFrame([("A", "1", 10), ("A", "1", 13)], schemas.WAITING_LIST)
    asked = spark.createDataFrame([("A", "1"), ("B", "1")], "source_station STRING, train_number STRING")
    assert [a for _, a in rows(answer_waiting_list(asked, waiting), "source_station", "answer")] == [
        "Predicted Waiting List: 12",
        "Predicted Waiting List: N/A",
    ]
    schedule = spark.createDataFrame(
        [("1", "A", "B", "2025-01-01"), ("2", "A", "B", "2025-01-01"), ("3", "A", "C", "2025-01-01")], schemas.SCHEDULE
    )
    questions = spark.createDataFrame(
        [("A", "B", "2025-01-01")] * 3 + [("B", "A", "2025-01-01")],
        "source_station STRING, destination_station STRING, scheduled_departure STRING",
    )
    assert rows(find_routes(questions, schedule), "train_number", "answer") == [
        ("1", "Train 1: A -> B"),
        ("2", "Train 2: A -> B"),
        (None, "No route found."),
    ]
    asked = spark.createDataFrame(
        [(7, "A", "B", "2025-01-01"), (7, "A", "B", "2025-01-01"), (8, "B", "A", "2025-01-01"), (9, None, "B", "2025-01-01")],
        "request_id INT, source_station STRING, destination_station STRING, scheduled_departure STRING",
    )
    assert rows(answer_routes(asked, schedule), "request_id", "n_routes", "answer") == [
        *[(7, 2, "Possible Routes:\nTrain 1: A -> B\nTrain 2: A -> B")] * 2,
        (8, 0, "No route found."),
        (9, 0, "No route found."),
    ]
    schedule.createOrReplaceTempView("schedule_view")
    odd = run_sql(spark, "SELECT * FROM schedule_view WHERE source_station = :s", s="A' OR '1'='1")
    assert odd.count() == 0


def test_prediction_vs_actual(spark, rows):
    schema = "train_number INT, station STRING, delay STRING"
    one = spark.createDataFrame([(1, "A", "10 Min"), (1, "A", "10 Min"), (1, "B", "N/A")], schema)
    two = spark.createDataFrame([(1, "A", "01:00 Hr"), (2, "A", "On Time")], schema)
    predictions = spark.createDataFrame([(1, "A", 30.0), (1, "B", 1.0)], "train_number INT, station STRING, predicted_delay_min DOUBLE")
    got = rows(prediction_vs_actual(predictions, actual_delays(one, two)))
    assert got == [(1, "A", 30.0, 80 / 3, 3, 30.0 - 80 / 3, 30.0 - 80 / 3)]


def test_flow_from_documents(spark, tmp_path, rows):
    documents = spark.createDataFrame(
        [("1", "T1", [["Date", "A", '{"label":"B"}'], ["2025,1,1", "10", None], ["2025,1,2", "30", "5"]])], schemas.DELAY_DOCUMENT
    )
    raw = spark.createDataFrame([("01-01-2025", 1.0, 2.0, 61, 4.0)], schemas.WEATHER_CSV)
    stations = spark.createDataFrame([("A", "a", 1.0, 2.0)], schemas.STATION_MASTER)
    weather = attach_stations(standardise_weather(raw), stations)
    root = str(tmp_path / "facts")
    final = build_delay_facts(documents, weather, root, "delay_facts_view")
    assert rows(final, "station", "travel_date", "delay_min", "rolling_72hr_avg_delay", "weather_code") == [
        ("A", d(1), 10, 0.0, 61.0),
        ("A", d(2), 30, 10.0, 0.0),
        ("B", d(1), None, 0.0, 61.0),
        ("B", d(2), 5, 0.0, 0.0),
    ]
    assert [(r.version, r.operation) for r in history(spark, root).collect()] == [(2, "WEATHER"), (1, "ENRICH"), (0, "INGEST")]
    assert spark.table("delay_facts_view").count() == 4


def test_enrich_default_holidays(spark, rows):
    df = spark.createDataFrame([(1, "A", d(26), 5)], FACTS)
    assert rows(enrich_facts(df), "day_type", "is_maintenance_likely") == [(2, 0)]
