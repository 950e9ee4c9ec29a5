"""Bookings: flags, route statistics, lookups of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from transit_spark.catalog import proxies as px
from transit_spark.catalog.registry import Registry
from transit_spark.functions import bookings as fb
from transit_spark.operators.lookups import waiting_list_average
from transit_spark.operators.reshape import rename, underscore_names
from transit_spark.operators.routes import enrich_routes, global_stats, lookup_route_stats, route_stats
from transit_spark.plans.bookings import (
    CATALOG_COLUMNS,
    CATALOG_ROUTE_KEYS,
    PATH_TO_CATALOG,
    silver_from_catalog,
    silver_from_path,
)
from transit_spark.session import stage

REGISTRY = Registry()
query = REGISTRY.query

_FLAGS = ["IsWaitlisted", "WaitlistRank", "IsHoliday", "HasConcession", "IsConfirmed_AtBooking", "label"]


@query(
    "bookings_silver",
    px.with_clause(px.BOOKINGS, px.SILVER)
    + 'SELECT "PNR", "TrainNo", "BookingDate", "TravelDate", "Distance", "Fare", "Passengers", "Waitlist No", '
    + ", ".join(f'"{c}"' for c in _FLAGS)
    + " FROM silver",
)
def bookings_silver(spark, sf_dir) -> DataFrame:
    silver = silver_from_path(px.bookings(spark, sf_dir))
    return silver.select(
        "PNR", "TrainNo", "BookingDate", "TravelDate", "Distance", "Fare", "Passengers", "`Waitlist No`", *_FLAGS
    )


def catalog_bookings(spark, sf_dir) -> DataFrame:
    return rename(px.bookings(spark, sf_dir), PATH_TO_CATALOG)


_CATALOG_SILVER = """catalog_silver AS (
  SELECT "PNR" AS "PNR_Number", "FromStation" AS "Source_Station", "ToStation" AS "Destination_Station",
         "Class" AS "Class_of_Travel", "TrainType" AS "Train_Type", "Distance" AS "Travel_Distance",
         "Passengers" AS "Number_of_Passengers", "Waitlist No" AS "Waitlist_Position",
         CASE WHEN "Waitlist No" IS NULL OR "Waitlist No" = 'null' THEN 0 ELSE 1 END AS "IsWaitlisted",
         CASE WHEN "Waitlist No" IS NULL OR "Waitlist No" = 'null' THEN 0
              ELSE TRY_CAST(regexp_extract("Waitlist No", 'WL([0-9]+)', 1) AS INTEGER) END AS "WaitlistRank",
         CASE WHEN "Holiday Season" = 'Yes' THEN 1 ELSE 0 END AS "IsHoliday",
         CASE WHEN "Concession" IS NULL OR "Concession" = 'None' THEN 0 ELSE 1 END AS "HasConcession",
         CASE WHEN "BookingStatus" = 'Confirmed' THEN 1 ELSE 0 END AS "IsConfirmed_AtBooking",
         CASE WHEN "FinalStatus" = 'Confirmed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM bookings WHERE "Distance" IS NOT NULL AND "Passengers" IS NOT NULL)"""


@query("bookings_silver_catalog", px.with_clause(px.BOOKINGS, _CATALOG_SILVER) + "SELECT * FROM catalog_silver")
def bookings_silver_catalog(spark, sf_dir) -> DataFrame:
    return silver_from_catalog(catalog_bookings(spark, sf_dir)).select(
        "PNR_Number", *CATALOG_ROUTE_KEYS, "Travel_Distance", "Number_of_Passengers", "Waitlist_Position", *_FLAGS
    )


@query(
    "rename_standardise",
    px.with_clause(px.BOOKINGS)
    + 'SELECT "PNR" AS "PNR_Number", "Holiday Season" AS "Holiday_or_Peak_Season", "Waitlist No" AS "Waitlist_Position", '
    + '"No of Stations" AS "No_of_Stations", "Distance" AS "Travel_Distance" FROM bookings WHERE "Waitlist No" IS NOT NULL',
)
def rename_standardise(spark, sf_dir) -> DataFrame:
    chosen = catalog_bookings(spark, sf_dir).select(
        "`PNR Number`", "`Holiday or Peak Season`", "`Waitlist Position`", "`No of Stations`", "`Travel Distance`"
    )
    return underscore_names(chosen.dropna(subset=["`Waitlist Position`"]))


@query(
    "waitlist_rank",
    """SELECT text, CASE WHEN text IS NULL OR text = 'null' THEN 0
         ELSE TRY_CAST(regexp_extract(text, 'WL([0-9]+)', 1) AS INTEGER) END AS waitlist_rank,
       CASE WHEN number > 0 THEN printf('WL%03d', number) END AS waitlist_text, count(*) AS n
FROM (SELECT CAST(l_quantity AS INTEGER) - 2 AS number,
             CASE WHEN l_returnflag = 'N' THEN 'null' WHEN l_linenumber = 1 THEN NULL
                  WHEN l_returnflag = 'A' THEN 'WL' || CAST(l_quantity AS INTEGER)
                  ELSE 'RAC' || CAST(l_quantity AS INTEGER) END AS text FROM lineitem)
GROUP BY ALL""",
)
def waitlist_rank(spark, sf_dir) -> DataFrame:
    quantity = F.col("l_quantity").cast("int")
    text = (
        F.when(F.col("l_returnflag") == "N", "null")
        .when(F.col("l_linenumber") == 1, F.lit(None).cast("string"))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("WL"), quantity.cast("string")))
        .otherwise(F.concat(F.lit("RAC"), quantity.cast("string")))
    )
    lines = px.table(spark, sf_dir, "lineitem").select(text.alias("text"), (quantity - 2).alias("number"))
    return lines.groupBy(
        "text",
        fb.waitlist_rank(F.col("text")).alias("waitlist_rank"),
        fb.waitlist_text(F.col("number")).alias("waitlist_text"),
    ).agg(F.count(F.lit(1)).alias("n"))


def silver(spark, sf_dir) -> DataFrame:
    """The columns of the silver table that route statistics need."""
    return silver_from_path(px.bookings(spark, sf_dir))


@query("route_stats", px.with_clause(px.BOOKINGS, px.SILVER, px.GOLD) + "SELECT * FROM gold")
def route_stats_query(spark, sf_dir) -> DataFrame:
    return route_stats(silver(spark, sf_dir))


@query(
    "route_stats_catalog",
    px.with_clause(px.BOOKINGS, _CATALOG_SILVER)
    + """SELECT "Source_Station", "Destination_Station", "Class_of_Travel", "Train_Type",
       avg(label) AS route_confirmation_rate, CAST(sum("Travel_Distance") AS DOUBLE) / count(*) AS avg_distance,
       count("PNR_Number") AS bookings_count
FROM catalog_silver GROUP BY ALL""",
)
def route_stats_catalog(spark, sf_dir) -> DataFrame:
    return route_stats(silver_from_catalog(catalog_bookings(spark, sf_dir)), CATALOG_ROUTE_KEYS, **CATALOG_COLUMNS)


@query(
    "route_enrich",
    px.with_clause(px.BOOKINGS, px.SILVER, px.GOLD)
    + """SELECT s."PNR", s."FromStation", s."ToStation", s."Class", s."TrainType", s."Fare", s.label,
       g.route_confirmation_rate, g.avg_fare_on_route, g.avg_distance, g.bookings_count
FROM silver s LEFT JOIN gold g USING ("FromStation", "ToStation", "Class", "TrainType")""",
)
def route_enrich(spark, sf_dir) -> DataFrame:
    # Written once: the statistics and the rows they go back to read the same silver table.
    rows = stage(
        silver(spark, sf_dir).select("PNR", "FromStation", "ToStation", "Class", "TrainType", "Distance", "Fare", "label")
    )
    return enrich_routes(rows).drop("Distance")


_GLOBAL = """overall AS (
  SELECT avg(label) AS route_confirmation_rate, CAST(sum("Distance") AS DOUBLE) / count("Distance") AS avg_distance,
         CAST(count("PNR") AS DOUBLE) AS bookings_count FROM silver)"""


@query("global_stats", px.with_clause(px.BOOKINGS, px.SILVER, _GLOBAL) + "SELECT * FROM overall")
def global_stats_query(spark, sf_dir) -> DataFrame:
    return global_stats(silver(spark, sf_dir))


def _lookup_sql(weight: str) -> str:
    return (
        px.with_clause(px.BOOKINGS, px.SILVER, px.GOLD, _GLOBAL, px.BOOKING_REQUESTS)
        + f"""SELECT r.request_id, g.rate IS NOT NULL AS route_known,
       round(coalesce(g.rate, o.route_confirmation_rate), 6) AS route_confirmation_rate,
       round(CASE WHEN g.rate IS NULL THEN o.avg_distance ELSE g.distance END, 6) AS avg_distance,
       round(CASE WHEN g.rate IS NULL THEN o.bookings_count ELSE g.bookings END, 6) AS bookings_count,
       round(CASE WHEN g.rate IS NULL THEN o.avg_distance ELSE g.distance END * 0.5, 6) AS fare_estimate
FROM booking_requests r CROSS JOIN overall o LEFT JOIN (
  SELECT "FromStation", "ToStation", "Class", sum(route_confirmation_rate * {weight}) / sum({weight}) AS rate,
         sum(avg_distance * {weight}) / sum({weight}) AS distance,
         CAST(sum(bookings_count) AS DOUBLE) / count(*) AS bookings
  FROM gold GROUP BY ALL) g ON g."FromStation" = r.from_station AND g."ToStation" = r.to_station AND g."Class" = r.travel_class"""
    )


def _looked_up(spark, sf_dir, weighted: bool) -> DataFrame:
    rows = stage(
        silver(spark, sf_dir).select("PNR", "FromStation", "ToStation", "Class", "TrainType", "Distance", "Fare", "label")
    )
    requests = px.booking_requests(spark, sf_dir).select(
        "request_id",
        F.col("from_station").alias("FromStation"),
        F.col("to_station").alias("ToStation"),
        F.col("travel_class").alias("Class"),
    )
    # Averages of averages are sums of doubles in any order, here around a thousand: their last digits are noise.
    found = lookup_route_stats(requests, route_stats(rows), global_stats(rows), weighted=weighted)
    return found.select(
        "request_id",
        "route_known",
        *[
            F.round(c, 6).alias(c)
            for c in ("route_confirmation_rate", "avg_distance", "bookings_count", "fare_estimate")
        ],
    )


@query("route_stats_lookup", _lookup_sql("1"))
def route_stats_lookup(spark, sf_dir) -> DataFrame:
    return _looked_up(spark, sf_dir, weighted=False)


@query("route_stats_lookup_weighted", _lookup_sql("bookings_count"))
def route_stats_lookup_weighted(spark, sf_dir) -> DataFrame:
    return _looked_up(spark, sf_dir, weighted=True)


@query(
    "confidence_band",
    px.with_clause(px.BOOKINGS, px.SILVER, px.GOLD)
    + """SELECT *, CASE WHEN route_confirmation_rate >= 0.75 OR route_confirmation_rate <= 0.25 THEN 'High'
  WHEN route_confirmation_rate >= 0.60 OR route_confirmation_rate <= 0.40 THEN 'Medium' ELSE 'Low' END AS confidence
FROM (SELECT "FromStation", "ToStation", "Class", "TrainType", route_confirmation_rate FROM gold)""",
)
def confidence_band(spark, sf_dir) -> DataFrame:
    stats = route_stats(silver(spark, sf_dir))
    return stats.select(
        "FromStation",
        "ToStation",
        "Class",
        "TrainType",
        "route_confirmation_rate",
        fb.confidence_band(F.col("route_confirmation_rate")).alias("confidence"),
    )


@query(
    "waiting_list_avg",
    px.with_clause(px.WAITING_LIST)
    + """SELECT *, 'Predicted Waiting List: ' || CAST(round_even(avg_waiting, 0) AS BIGINT) AS answer FROM (
  SELECT source_station, train_number, CAST(sum(waiting_list) AS DOUBLE) / count(waiting_list) AS avg_waiting
  FROM waiting_list GROUP BY ALL)""",
)
def waiting_list_avg(spark, sf_dir) -> DataFrame:
    return waiting_list_average(px.waiting_list(spark, sf_dir))
