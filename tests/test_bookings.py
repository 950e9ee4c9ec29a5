import pytest
from pyspark.sql import functions as F

from transit_spark import schemas
from transit_spark.operators.reshape import rename, top_rows, underscore_names
from transit_spark.operators.routes import class_route_stats, enrich_routes, global_stats, lookup_route_stats, route_stats
from transit_spark.plans.bookings import (
    CATALOG_COLUMNS,
    CATALOG_ROUTE_KEYS,
    PATH_TO_CATALOG,
    build_booking_tables,
    build_catalog_tables,
    request_inputs,
    silver_from_catalog,
    silver_from_path,
    training_set,
)


def booking(pnr, waitlist, final, fare=1200, train_type="Express", to="BCT"):
    return (
        pnr, 12345, "01-Sep", "SL", "GN", "NDLS", to, "01-Jan", "WL", 2, "Adult", "Online", 1380, 10, 18,
        train_type, fare, "None", "No", waitlist, final,
    )


def frame(spark, *bookings):
    return spark.createDataFrame(list(bookings), schemas.BOOKINGS)


def three(spark):
    return frame(
        spark, booking("a", "null", "Confirmed"), booking("b", "WL12", "Confirmed"), booking("c", "WL15", "Not Confirmed")
    )


def test_silver_path(spark, rows):
    df = frame(spark, booking("a", "null", "Confirmed"), booking("b", None, "x"), booking("c", "RAC3", "x"), booking("d", "WL1", "x", fare=None))
    got = rows(silver_from_path(df), "PNR", "IsWaitlisted", "WaitlistRank", "HasConcession", "label")
    assert got == [("a", 0, 0, 0, 1.0), ("b", 1, None, 0, 0.0), ("c", 1, None, 0, 0.0)]


def test_silver_catalog(spark, rows):
    df = frame(spark, booking("a", "null", "Confirmed"), booking("b", None, "x"), booking("d", "WL1", "x", fare=None))
    silver = silver_from_catalog(rename(df, PATH_TO_CATALOG))
    assert not [c for c in silver.columns if " " in c]
    assert rows(silver, "PNR_Number", "IsWaitlisted", "WaitlistRank") == [("a", 0, 0), ("b", 0, 0), ("d", 1, 1)]
    stats = route_stats(silver, CATALOG_ROUTE_KEYS, **CATALOG_COLUMNS)
    assert rows(stats, "route_confirmation_rate", "avg_distance", "bookings_count") == [(1 / 3, 1380.0, 3)]


def test_route_stats_and_enrich(spark, rows):
    silver = silver_from_path(three(spark))
    assert rows(route_stats(silver).drop("FromStation", "ToStation", "Class", "TrainType")) == [(2 / 3, 1200.0, 1380.0, 3)]
    enriched = enrich_routes(silver)
    assert enriched.count() == 3 and rows(enriched, "bookings_count") == [(3,)] * 3


def stats_frame(spark):
    return spark.createDataFrame(
        [("A", "B", "SL", "X", 1.0, 100.0, 9), ("A", "B", "SL", "Y", 0.0, 200.0, 1)],
        "FromStation STRING, ToStation STRING, Class STRING, TrainType STRING, route_confirmation_rate DOUBLE, avg_distance DOUBLE, bookings_count BIGINT",
    )


def test_average_of_averages(spark, rows):
    stats = stats_frame(spark)
    columns = ["route_confirmation_rate", "avg_distance", "bookings_count"]
    assert rows(class_route_stats(stats), *columns) == [(0.5, 150.0, 5.0)]
    assert rows(class_route_stats(stats, weighted=True), *columns) == [(0.9, 110.0, 5.0)]


def test_unknown_route_falls_back(spark, rows):
    overall = spark.createDataFrame([(0.4, 700.0, 50.0)], "route_confirmation_rate DOUBLE, avg_distance DOUBLE, bookings_count DOUBLE")
    requests = spark.createDataFrame([(1, "A", "B", "SL"), (2, "A", "Q", "SL")], "i INT, FromStation STRING, ToStation STRING, Class STRING")
    found = lookup_route_stats(requests, stats_frame(spark), overall)
    assert rows(found, "i", "route_known", "route_confirmation_rate", "avg_distance", "fare_estimate") == [
        (1, True, 0.5, 150.0, 75.0),
        (2, False, 0.4, 700.0, 350.0),
    ]


def test_request_inputs(spark, rows):
    silver = silver_from_path(three(spark))
    requests = spark.createDataFrame(
        [(1, "Waitlisted", 7, "SL", "NDLS", "BCT", "15-Jun"), (2, "Confirmed", 0, "SL", "NDLS", "XX", "15-Jun")],
        schemas.BOOKING_REQUESTS,
    )
    inputs = request_inputs(requests, route_stats(silver), global_stats(silver), {"Quota": "Tatkal"})
    assert rows(inputs, "TrainNo", "`Waitlist No`", "IsWaitlisted", "WaitlistRank", "IsConfirmed_AtBooking", "Distance", "Quota", "HasConcession") == [
        (1, "WL007", 1, 7, 0, 1380, "Tatkal", 0),
        (2, None, 0, 0, 1, 1380, "Tatkal", 0),
    ]


def test_statistics_from_training_rows_only(spark):
    bookings = [booking(str(i), "null", "Confirmed" if i % 2 else "x", to=f"T{i % 5}") for i in range(200)]
    silver = silver_from_path(frame(spark, *bookings))
    train, test = training_set(silver, fit_on="train")
    counts = {r.ToStation: r.n for r in train.groupBy("ToStation").agg(F.count("*").alias("n")).collect()}
    assert train.count() + test.count() == 200
    assert all(r.bookings_count == counts[r.ToStation] for r in test.collect())
    everything = training_set(silver)[1]
    assert {r.bookings_count for r in everything.collect()} == {40}
    with pytest.raises(ValueError):
        training_set(silver, fit_on="test")


def test_layers_are_published(spark, tmp_path, rows):
    built = build_booking_tables(three(spark), str(tmp_path / "lake"), prefix="t_")
    assert {k: v.count() for k, v in built.items()} == {"bronze": 3, "silver": 3, "gold": 1}
    assert spark.table("t_silver").filter("IsWaitlisted = 1").count() == 2
    trained = build_catalog_tables(rename(three(spark), PATH_TO_CATALOG), "cat_silver", "cat_gold")
    assert rows(trained, "PNR_Number", "bookings_count") == [("a", 3), ("b", 3), ("c", 3)]
    assert spark.table("cat_gold").count() == 1


def test_reshape(spark, rows):
    df = spark.createDataFrame([(1, 2), (3, 4)], "`a b` INT, c INT")
    assert underscore_names(df).columns == ["a_b", "c"]
    assert rows(top_rows(df, 1, F.col("c").desc())) == [(3, 4)]
