"""Requests against lookups: features, scores, answers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from transit_spark.catalog import delay_queries as dq, proxies as px
from transit_spark.catalog.registry import Registry
from transit_spark.operators.compare import actual_delays, prediction_vs_actual
from transit_spark.operators.lookups import answer_routes, find_routes, run_sql, split_requests, stop_lookup
from transit_spark.operators.ordered import dense_codes
from transit_spark.plans.delays import prediction_rows, request_features, result_documents, score_delays
from transit_spark.session import stage

REGISTRY = Registry()
query = REGISTRY.query

_CODES = """codes AS (SELECT station, CAST(row_number() OVER (ORDER BY station) - 1 AS INTEGER) AS station_enc
          FROM (SELECT DISTINCT station FROM lookup))"""

_SCORED = """scored AS (
  SELECT r.train_number, r.travel_date, l.station, c.station_enc, CAST(month(r.travel_date) AS INTEGER) AS month,
         CAST(day(r.travel_date) AS INTEGER) AS day, CAST(isodow(r.travel_date) - 1 AS INTEGER) AS day_of_week,
         CAST(weekofyear(r.travel_date) AS INTEGER) AS week,
         CASE WHEN dayofweek(r.travel_date) IN (0, 6) THEN 1 ELSE 0 END AS day_type,
         coalesce(l.rolling_72hr_avg_delay, 0) AS rolling_72hr_avg_delay, l.is_maintenance_likely,
         round_even(coalesce(l.rolling_72hr_avg_delay, 0), 1) AS predicted_delay_min
  FROM delay_requests r JOIN lookup l ON l.train_number = r.train_number JOIN codes c ON c.station = l.station)"""

_CATEGORY = """CASE WHEN predicted_delay_min <= 15 THEN 'On Time' WHEN predicted_delay_min <= 60 THEN 'Slight Delay'
  ELSE 'Significant Delay' END"""

_BASE = px.with_clause(px.FACTS, dq.ENRICHED, dq.LOOKUP_SQL, px.DELAY_REQUESTS, _CODES, _SCORED)

_UNKNOWN = "'Train ' || {t} || ' not found. Please check the train number and try again.'"


def _lookup(spark, sf_dir) -> DataFrame:
    """The lookup is small next to the facts and read several times, so it is written once."""
    return stage(dq.lookup(spark, sf_dir).drop("delay_min"))


def scored(spark, sf_dir, lookup: DataFrame) -> DataFrame:
    requests = px.delay_requests(spark, sf_dir)
    features = request_features(requests, lookup, dense_codes(lookup, "station", "station_enc"))
    return score_delays(features)


@query("score_requests", _BASE + f"SELECT *, {_CATEGORY} AS delay_category FROM scored")
def score_requests(spark, sf_dir) -> DataFrame:
    return scored(spark, sf_dir, _lookup(spark, sf_dir)).drop("prediction")


@query(
    "unknown_requests",
    _BASE
    + f"""SELECT train_number, travel_date, {_UNKNOWN.format(t='train_number')} AS error FROM delay_requests
WHERE train_number NOT IN (SELECT train_number FROM lookup)""",
)
def unknown_requests(spark, sf_dir) -> DataFrame:
    pairs = px.facts(spark, sf_dir).select("train_number").distinct()
    return split_requests(px.delay_requests(spark, sf_dir), pairs)[1]


@query(
    "stop_lookup",
    _BASE
    + f""", q AS (SELECT event_id AS request_id,
     CASE WHEN event_id % 10 = 0 THEN train_number + 900001 ELSE train_number END AS train_number,
     CASE WHEN event_id % 7 = 0 THEN 'U0' ELSE station END AS station, travel_date FROM facts)
SELECT q.request_id, q.train_number, q.station, q.travel_date, s.predicted_delay_min,
  CASE WHEN q.train_number NOT IN (SELECT train_number FROM scored) THEN 'Error: ' || {_UNKNOWN.format(t='q.train_number')}
       WHEN s.predicted_delay_min IS NULL
         THEN 'Station ''' || q.station || ''' not found in route for train ' || q.train_number
       ELSE printf('Predicted Delay at %s: %.2f minutes', q.station, s.predicted_delay_min) END AS answer
FROM q LEFT JOIN scored s USING (train_number, station, travel_date)""",
)
def stop_lookup_query(spark, sf_dir) -> DataFrame:
    unknown, elsewhere = F.col("event_id") % 10 == 0, F.col("event_id") % 7 == 0
    requests = px.facts(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.when(unknown, F.col("train_number") + 900001).otherwise(F.col("train_number")).alias("train_number"),
        F.when(elsewhere, "U0").otherwise(F.col("station")).alias("station"),
        "travel_date",
    )
    lookup = _lookup(spark, sf_dir)
    stops = scored(spark, sf_dir, lookup).select("train_number", "travel_date", "station", "predicted_delay_min")
    return stop_lookup(requests, stops, lookup)


@query(
    "result_documents",
    _BASE
    + f"""SELECT train_number, travel_date, '{{"train_number":' || train_number || ',"prediction_date":"' ||
       strftime(travel_date, '%Y-%m-%d 00:00:00') || '","stops":[' ||
       string_agg('{{"station":"' || station || '","predicted_delay_min":' || CAST(predicted_delay_min AS VARCHAR) ||
         ',"delay_category":"' || {_CATEGORY} || '"}}', ',' ORDER BY station) || '],"error":null}}' AS document
FROM scored GROUP BY train_number, travel_date
UNION ALL
SELECT train_number, travel_date, '{{"train_number":' || train_number || ',"prediction_date":"' ||
       strftime(travel_date, '%Y-%m-%d 00:00:00') || '","stops":[],"error":"' || {_UNKNOWN.format(t='train_number')} || '"}}'
FROM delay_requests WHERE train_number NOT IN (SELECT train_number FROM lookup)""",
)
def result_documents_query(spark, sf_dir) -> DataFrame:
    lookup = _lookup(spark, sf_dir)
    errors = split_requests(px.delay_requests(spark, sf_dir), lookup)[1]
    return result_documents(scored(spark, sf_dir, lookup), errors)


@query(
    "delay_predictions",
    _BASE + "SELECT station, predicted_delay_min, train_number, CAST(travel_date AS VARCHAR) AS query_date FROM scored",
)
def delay_predictions(spark, sf_dir) -> DataFrame:
    return prediction_rows(scored(spark, sf_dir, _lookup(spark, sf_dir)))


@query(
    "route_finder",
    px.with_clause(px.SCHEDULE)
    + """, q AS (SELECT DISTINCT 'N' || (o_custkey % 25) AS source_station,
     'N' || (o_custkey % 6) AS destination_station, strftime(o_orderdate, '%Y-%m-%d') AS scheduled_departure FROM orders)
SELECT q.*, s.train_number, coalesce('Train ' || s.train_number || ': ' || q.source_station || ' -> ' || q.destination_station,
       'No route found.') AS answer
FROM q LEFT JOIN schedule s USING (source_station, destination_station, scheduled_departure)""",
)
def route_finder(spark, sf_dir) -> DataFrame:
    return find_routes(route_requests(spark, sf_dir), px.schedule(spark, sf_dir))


def route_requests(spark, sf_dir) -> DataFrame:
    return px.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string")).alias("source_station"),
        F.concat(F.lit("N"), (F.col("o_custkey") % 6).cast("string")).alias("destination_station"),
        F.col("o_orderdate").cast("date").cast("string").alias("scheduled_departure"),
    )


@query(
    "route_answers",
    px.with_clause(px.SCHEDULE)
    + """, q AS (SELECT o_orderkey AS request_id, 'N' || (o_custkey % 25) AS source_station,
     'N' || (o_custkey % 6) AS destination_station, strftime(o_orderdate, '%Y-%m-%d') AS scheduled_departure FROM orders),
a AS (SELECT source_station, destination_station, scheduled_departure, count(*) AS n_routes, 'Possible Routes:' || chr(10) ||
     string_agg('Train ' || train_number || ': ' || source_station || ' -> ' || destination_station, chr(10) ORDER BY train_number) AS answer
     FROM schedule GROUP BY ALL)
SELECT q.*, coalesce(n_routes, 0) AS n_routes, coalesce(answer, 'No route found.') AS answer
FROM q LEFT JOIN a USING (source_station, destination_station, scheduled_departure)""",
)
def route_answers(spark, sf_dir) -> DataFrame:
    """Every request with its id and the routes in one text."""
    return answer_routes(route_requests(spark, sf_dir), px.schedule(spark, sf_dir))


@query(
    "route_finder_sql",
    px.with_clause(px.SCHEDULE)
    + """SELECT train_number, source_station, destination_station, scheduled_departure FROM schedule
WHERE source_station = 'N5' AND destination_station = 'N0' AND scheduled_departure >= '1996-01-01'""",
)
def route_finder_sql(spark, sf_dir) -> DataFrame:
    px.schedule(spark, sf_dir).createOrReplaceTempView("transit_schedule")
    return run_sql(
        spark,
        "SELECT * FROM transit_schedule WHERE source_station = :source AND destination_station = :destination "
        "AND scheduled_departure >= :departure",
        source="N5",
        destination="N0",
        departure="1996-01-01",
    )


def day_files(spark, sf_dir) -> list[DataFrame]:
    """Scraped delay text in three tables, one per ten days; together they hold every fact."""
    facts = px.facts(spark, sf_dir)
    minutes = F.col("delay_min")

    def two(number):
        return F.lpad(number.cast("string"), 2, "0")

    text = (
        F.when(minutes.isNull(), "N/A")
        .when(minutes == 0, "On Time")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" Min")))
        .otherwise(F.concat(two(F.floor(minutes / 60)), F.lit(":"), two(minutes % 60), F.lit(" Hr")))
    )
    rows = facts.select("train_number", "station", "travel_date", text.alias("delay"))
    day = F.day("travel_date")
    parts = (day <= 10, (day > 10) & (day <= 20), day > 20)
    return [rows.filter(part).drop("travel_date") for part in parts]


@query(
    "prediction_vs_actual",
    _BASE
    + """, actual AS (SELECT train_number, station, CAST(sum(delay_min) AS DOUBLE) / count(*) AS actual_delay_min, count(*) AS n_actual
     FROM facts WHERE delay_min IS NOT NULL GROUP BY ALL)
SELECT train_number, station, predicted_delay_min, actual_delay_min, n_actual,
       predicted_delay_min - actual_delay_min AS error_min, abs(predicted_delay_min - actual_delay_min) AS abs_error_min
FROM (SELECT train_number, station, round_even(rolling_72hr_avg_delay, 1) AS predicted_delay_min FROM lookup)
JOIN actual USING (train_number, station)""",
)
def prediction_vs_actual_query(spark, sf_dir) -> DataFrame:
    predictions = dq.lookup(spark, sf_dir).select(
        "train_number", "station", F.bround("rolling_72hr_avg_delay", 1).alias("predicted_delay_min")
    )
    return prediction_vs_actual(predictions, actual_delays(*day_files(spark, sf_dir)))
