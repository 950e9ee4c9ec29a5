"""The railway tables as views over the supplied tables, in Spark and as SQL for the twin.

Every proxy covers its source tables whole and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from transit_spark.functions.weather import weather_risk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- delay facts: one per event; five stations to two trains -----------------------------------

def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").withColumn("k", k)
    return events.select(
        "event_id",
        (F.lit(10000) + F.floor(F.col("user_id") / 5) * 2 + F.floor(F.col("k") / 50)).cast("int").alias("train_number"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("station"),
        F.col("ts").cast("date").alias("travel_date"),
        F.when(F.col("k") % 10 != 0, F.floor("value").cast("int")).alias("delay_min"),
    )


FACTS = """facts AS (
  SELECT event_id,
         CAST(10000 + floor(user_id / 5) * 2 + floor(k / 50) AS INTEGER) AS train_number,
         'U' || CAST(user_id AS VARCHAR) AS station,
         CAST(ts AS DATE) AS travel_date,
         CASE WHEN k % 10 <> 0 THEN CAST(floor(value) AS INTEGER) END AS delay_min
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


# --- weather: every error event, so any number of rows per station and date ----------------------

def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type = 'error'")
    code = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("station_code"),
        F.col("ts").cast("date").alias("weather_date"),
        code.alias("weather_code"),
        F.col("value").cast("decimal(18,2)").alias("precipitation_mm"),
        weather_risk(code).alias("weather_risk_score"),
    )


RISK_SQL = """CASE WHEN {c} = 0 THEN 0 WHEN {c} IN (1, 2, 3) THEN 1 WHEN {c} IN (51, 53, 55) THEN 2
       WHEN {c} IN (61, 63, 65) THEN 3 WHEN {c} IN (80, 81, 82) THEN 3 WHEN {c} IN (45, 48) THEN 3
       WHEN {c} IN (95, 96, 99) THEN 4 ELSE 1 END"""

WEATHER = f"""weather AS (
  SELECT *, {RISK_SQL.format(c='weather_code')} AS weather_risk_score
  FROM (SELECT 'U' || CAST(user_id AS VARCHAR) AS station_code, CAST(ts AS DATE) AS weather_date,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS weather_code,
               CAST(value AS DECIMAL(18,2)) AS precipitation_mm
        FROM events WHERE event_type = 'error'))"""


# --- coordinates: even vectors are stations, odd ones weather points ----------------------------

def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("embedding")[0].cast("double").alias("latitude"),
        F.col("embedding")[1].cast("double").alias("longitude"),
    )


def weather_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).filter("vec_id % 2 = 1")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("S"), F.col("vec_id").cast("string"))
    return (
        _points(spark, sf_dir)
        .filter("vec_id % 2 = 0")
        .select(code.alias("station_code"), F.concat(F.lit("Station "), code).alias("station_name"), "latitude", "longitude")
    )


POINTS = """points AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS latitude, CAST(embedding[2] AS DOUBLE) AS longitude FROM embeddings),
weather_points AS (SELECT * FROM points WHERE vec_id % 2 = 1),
stations AS (SELECT 'S' || vec_id AS station_code, 'Station S' || vec_id AS station_name, latitude, longitude
             FROM points WHERE vec_id % 2 = 0)"""


# --- bookings: one per order line ---------------------------------------------------------------

def _station(key: str):
    return F.concat(F.lit("N"), F.col(key).cast("string"))


def _day_month(date: str):
    """Text such as ``01-Sep``."""
    day = F.lpad(F.day(date).cast("string"), 2, "0")
    return F.concat(day, F.lit("-"), F.monthname(F.col(date).cast("date")))


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    # Orders meet their customers first: a shuffle of the orders by customer is far less than one of all lines.
    booked = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        line.join(booked, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    number = (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).cast("string")
    waitlist = (
        F.when(F.col("l_returnflag") == "N", "null")
        .when(F.col("l_linenumber") == 1, F.lit(None).cast("string"))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("WL"), number))
        .otherwise(F.concat(F.lit("RAC"), number))
    )
    return joined.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("PNR"),
        (F.lit(10000) + F.col("l_partkey") % 100).cast("int").alias("TrainNo"),
        _day_month("o_orderdate").alias("BookingDate"),
        F.col("o_orderpriority").alias("Class"),
        F.col("c_mktsegment").alias("Quota"),
        _station("s_nationkey").alias("FromStation"),
        _station("c_nationkey").alias("ToStation"),
        _day_month("l_shipdate").alias("TravelDate"),
        F.when(F.col("l_linestatus") == "O", "Confirmed").otherwise("WL").alias("BookingStatus"),
        F.when(F.col("l_tax") < 0.08, F.col("l_quantity").cast("int")).alias("Passengers"),
        F.when(F.col("l_linenumber") % 2 == 0, "Adult").otherwise("Senior").alias("PassengerType"),
        F.when(F.col("l_linenumber") > 4, "Counter").otherwise("Online").alias("BookingChannel"),
        (F.col("p_size") * 40).cast("int").alias("Distance"),
        F.col("p_size").alias("No of Stations"),
        (F.col("p_size") % 24 + 1).alias("Travel Time"),
        F.col("p_type").alias("TrainType"),
        F.when(F.col("l_discount") < 0.1, F.floor("l_extendedprice").cast("int")).alias("Fare"),
        F.when(F.col("l_discount") == 0.0, "None")
        .when(F.col("l_discount") > 0.01, F.col("p_brand"))
        .alias("Concession"),
        F.when(F.col("l_tax") > 0.05, "Yes").otherwise("No").alias("Holiday Season"),
        waitlist.alias("Waitlist No"),
        F.when(F.col("o_orderstatus") == "F", "Confirmed").otherwise("Not Confirmed").alias("FinalStatus"),
    )


BOOKINGS = """bookings AS (
  SELECT l_orderkey || '-' || l_linenumber AS "PNR",
         CAST(10000 + l_partkey % 100 AS INTEGER) AS "TrainNo",
         strftime(o_orderdate, '%d-%b') AS "BookingDate",
         o_orderpriority AS "Class",
         c_mktsegment AS "Quota",
         'N' || s_nationkey AS "FromStation",
         'N' || c_nationkey AS "ToStation",
         strftime(l_shipdate, '%d-%b') AS "TravelDate",
         CASE WHEN l_linestatus = 'O' THEN 'Confirmed' ELSE 'WL' END AS "BookingStatus",
         CASE WHEN l_tax < 0.08 THEN CAST(l_quantity AS INTEGER) END AS "Passengers",
         CASE WHEN l_linenumber % 2 = 0 THEN 'Adult' ELSE 'Senior' END AS "PassengerType",
         CASE WHEN l_linenumber > 4 THEN 'Counter' ELSE 'Online' END AS "BookingChannel",
         p_size * 40 AS "Distance",
         p_size AS "No of Stations",
         p_size % 24 + 1 AS "Travel Time",
         p_type AS "TrainType",
         CASE WHEN l_discount < 0.1 THEN CAST(floor(l_extendedprice) AS INTEGER) END AS "Fare",
         CASE WHEN l_discount = 0.0 THEN 'None' WHEN l_discount > 0.01 THEN p_brand END AS "Concession",
         CASE WHEN l_tax > 0.05 THEN 'Yes' ELSE 'No' END AS "Holiday Season",
         CASE WHEN l_returnflag = 'N' THEN 'null' WHEN l_linenumber = 1 THEN NULL
              WHEN l_returnflag = 'A' THEN 'WL' || (l_linenumber * 10 + CAST(l_quantity AS INTEGER))
              ELSE 'RAC' || (l_linenumber * 10 + CAST(l_quantity AS INTEGER)) END AS "Waitlist No",
         CASE WHEN o_orderstatus = 'F' THEN 'Confirmed' ELSE 'Not Confirmed' END AS "FinalStatus"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""

# Both NULL treatments of the flags, by hand.
FLAGS_PRESENT = """
  CASE WHEN "Waitlist No" = 'null' THEN 0 ELSE 1 END AS "IsWaitlisted",
  CASE WHEN "Waitlist No" = 'null' THEN 0
       ELSE TRY_CAST(regexp_extract("Waitlist No", 'WL([0-9]+)', 1) AS INTEGER) END AS "WaitlistRank",
  CASE WHEN "Holiday Season" = 'Yes' THEN 1 ELSE 0 END AS "IsHoliday",
  CASE WHEN "Concession" = 'None' THEN 0 ELSE 1 END AS "HasConcession",
  CASE WHEN "BookingStatus" = 'Confirmed' THEN 1 ELSE 0 END AS "IsConfirmed_AtBooking",
  CASE WHEN "FinalStatus" = 'Confirmed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label"""

SILVER = f"""silver AS (
  SELECT *, {FLAGS_PRESENT} FROM bookings
  WHERE "Distance" IS NOT NULL AND "Fare" IS NOT NULL AND "Passengers" IS NOT NULL)"""

GOLD = """gold AS (
  SELECT "FromStation", "ToStation", "Class", "TrainType",
         avg(label) AS route_confirmation_rate,
         CAST(sum("Fare") AS DOUBLE) / count("Fare") AS avg_fare_on_route,
         CAST(sum("Distance") AS DOUBLE) / count("Distance") AS avg_distance,
         count("PNR") AS bookings_count
  FROM silver GROUP BY ALL)"""


# --- booking requests: one per order; some destinations are unknown -----------------------------

def booking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    waiting = (F.col("o_orderkey") % 4 * 7).cast("int")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("request_id"),
        (F.lit(10000) + F.col("o_orderkey") % 100).cast("int").alias("train_no"),
        F.when(waiting > 0, "Waitlisted").otherwise("Confirmed").alias("booking_status"),
        waiting.alias("waitlist_number"),
        F.col("o_orderpriority").alias("travel_class"),
        _station("c_nationkey").alias("from_station"),
        F.concat(F.lit("N"), (F.col("o_orderkey") % 30).cast("string")).alias("to_station"),
        _day_month("o_orderdate").alias("travel_date"),
    )


BOOKING_REQUESTS = """booking_requests AS (
  SELECT o_orderkey AS request_id, CAST(10000 + o_orderkey % 100 AS INTEGER) AS train_no,
         CASE WHEN o_orderkey % 4 > 0 THEN 'Waitlisted' ELSE 'Confirmed' END AS booking_status,
         CAST(o_orderkey % 4 * 7 AS INTEGER) AS waitlist_number, o_orderpriority AS travel_class,
         'N' || c_nationkey AS from_station, 'N' || (o_orderkey % 30) AS to_station,
         strftime(o_orderdate, '%d-%b') AS travel_date
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# --- delay requests: one per train and day, and one unknown train for every tenth train ---------

def delay_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.when(F.col("train_number") % 20 == 0, F.array(F.col("train_number"), F.col("train_number") + 900000))
    pairs = facts(spark, sf_dir).select("train_number", "travel_date").distinct()
    return pairs.select(
        F.explode(F.coalesce(train, F.array("train_number"))).alias("train_number"), "travel_date"
    )


DELAY_REQUESTS = """delay_requests AS (
  SELECT DISTINCT train_number, travel_date FROM facts
  UNION ALL
  SELECT DISTINCT train_number + 900000, travel_date FROM facts WHERE train_number % 20 = 0)"""


# --- schedule and waiting list: one row per order -----------------------------------------------

def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("train_number"),
        _station("c_nationkey").alias("source_station"),
        F.concat(F.lit("N"), (F.col("o_orderkey") % 5).cast("string")).alias("destination_station"),
        F.col("o_orderdate").cast("date").cast("string").alias("scheduled_departure"),
    )


SCHEDULE = """schedule AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS train_number, 'N' || c_nationkey AS source_station,
         'N' || (o_orderkey % 5) AS destination_station, strftime(o_orderdate, '%Y-%m-%d') AS scheduled_departure
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def waiting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        _station("c_nationkey").alias("source_station"),
        F.col("o_orderpriority").alias("train_number"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("waiting_list"),
    )


WAITING_LIST = """waiting_list AS (
  SELECT 'N' || c_nationkey AS source_station, o_orderpriority AS train_number,
         CAST(floor(o_totalprice / 1000) AS INTEGER) AS waiting_list
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def with_clause(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
