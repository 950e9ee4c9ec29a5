"""Delay facts: parsing, calendar, rolling history, weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from transit_spark.catalog import proxies as px
from transit_spark.catalog.registry import Registry
from transit_spark.functions.calendar import calendar_parts, date_from_day_first, date_from_parts, day_type
from transit_spark.functions.delays import delay_category, delay_minutes
from transit_spark.functions.weather import weather_risk
from transit_spark.operators.blocks import divider, keep_blocks, run_blocks
from transit_spark.operators.history import station_day_history
from transit_spark.operators.lookups import distinct_pairs, network_size, station_lookup
from transit_spark.operators.reshape import top_rows
from transit_spark.operators.weather import (
    attach_stations,
    backfill_weather,
    daily_weather,
    match_coverage,
    station_coverage,
)
from transit_spark.plans.delays import enrich_facts
from transit_spark.sources.delay_documents import unpivot_documents
from transit_spark.sources.pages import CardLayout, page_cards

REGISTRY = Registry()
query = REGISTRY.query

# Maintenance threshold that splits the test data; the library default is the fixed value.
THRESHOLD = 130
RECENT = [f"U{i}" for i in range(1, 10)]


@query(
    "json_props_parse",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
)
def json_props_parse(spark, sf_dir) -> DataFrame:
    events = px.table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k INT").alias("p")).select("event_id", "p.k")


def delay_documents(spark, sf_dir) -> DataFrame:
    """One document per train and month from the facts: worst delay per day and station.

    Some header cells are objects; every document has a bad date row and a short row.
    """
    worst = (
        px.facts(spark, sf_dir)
        .groupBy("train_number", "travel_date", "station")
        .agg(F.max("delay_min").cast("string").alias("delay"))
    )
    # A train has five stations and a month 31 days: lists hold five cells per day, and one row per day.
    per_day = worst.groupBy("train_number", "travel_date").agg(
        F.map_from_entries(F.collect_list(F.struct("station", "delay"))).alias("cells")
    )
    per_train = per_day.groupBy("train_number", F.trunc("travel_date", "month").alias("in_month")).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.map_keys("cells"))))).alias("stations"),
        F.sort_array(F.collect_list(F.struct("travel_date", F.map_entries("cells").alias("cells")))).alias("days"),
    )
    header = F.transform(
        "stations",
        lambda s: F.when(F.substring(s, -1, 1) < "5", F.to_json(F.struct(s.alias("label")))).otherwise(s),
    )

    def row(day):
        date = day["travel_date"]
        key = F.concat(F.year(date), F.lit(","), F.month(date), F.lit(","), F.day(date))
        return F.concat(F.array(key), F.transform("stations", lambda s: F.try_element_at(F.map_from_entries(day["cells"]), s)))

    bad = F.array(F.concat(F.array(F.lit("2024,2,30")), F.transform("stations", lambda s: F.lit("1"))))
    short = F.array(F.array(F.lit("2023,12,31"), F.lit("7")))
    data = F.concat(F.array(F.concat(F.array(F.lit("Date")), header)), F.transform("days", row), bad, short)
    return per_train.select(
        F.col("train_number").cast("string").alias("Number"),
        F.concat(F.lit("Train "), F.col("train_number").cast("string")).alias("Name"),
        data.alias("data"),
    )


MATRIX_SQL = """worst AS (SELECT train_number, travel_date, station, max(delay_min) AS delay_min FROM facts GROUP BY ALL),
s AS (SELECT DISTINCT train_number, date_trunc('month', travel_date) AS in_month, station FROM worst),
d AS (SELECT DISTINCT train_number, date_trunc('month', travel_date) AS in_month, travel_date FROM worst)"""


@query(
    "matrix_unpivot",
    px.with_clause(px.FACTS, MATRIX_SQL)
    + """SELECT s.train_number, 'Train ' || s.train_number AS train_name, s.station, w.delay_min, d.travel_date
FROM s JOIN d USING (train_number, in_month) LEFT JOIN worst w
  ON w.train_number = s.train_number AND w.station = s.station AND w.travel_date = d.travel_date
UNION ALL
SELECT train_number, 'Train ' || train_number, min(station), 7, DATE '2023-12-31' FROM s GROUP BY train_number, in_month""",
)
def matrix_unpivot(spark, sf_dir) -> DataFrame:
    cells = unpivot_documents(delay_documents(spark, sf_dir))
    return cells.filter("travel_date IS NOT NULL").select(
        "train_number", "train_name", "station", "delay_min", "travel_date"
    )


@query(
    "bad_record_split",
    """SELECT o_orderkey, date_text, try_strptime(CASE WHEN bad THEN 'x' ELSE date_text END, '%Y,%m,%d')::DATE AS travel_date,
       try_strptime(CASE WHEN bad THEN 'x' ELSE date_text END, '%Y,%m,%d') IS NULL AS is_rejected
FROM (SELECT o_orderkey, o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 AS bad,
             CASE WHEN o_orderkey % 17 = 0 THEN 'n/a'
                  WHEN o_orderkey % 19 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) || ',1'
                  ELSE year(o_orderdate) || ',' || (o_orderkey % 14) || ',' || (o_custkey % 33) END AS date_text
      FROM orders)""",
)
def bad_record_split(spark, sf_dir) -> DataFrame:
    year = F.year("o_orderdate").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 17 == 0, "n/a")
        .when(F.col("o_orderkey") % 19 == 0, F.concat(year, F.lit(",1")))
        .otherwise(F.concat_ws(",", year, F.col("o_orderkey") % 14, F.col("o_custkey") % 33))
    )
    dated = px.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("date_text"))
    parsed = dated.withColumn("travel_date", date_from_parts(F.col("date_text")))
    return parsed.withColumn("is_rejected", F.col("travel_date").isNull())


@query(
    "date_parse",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS weather_date FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0""",
)
def date_parse(spark, sf_dir) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(
        F.date_format("o_orderdate", "dd-MM-yyyy")
    )
    return px.table(spark, sf_dir, "orders").select("o_orderkey", date_from_day_first(text).alias("weather_date"))


# The order dates end in 2001, so 24 years are added to reach the holiday calendar.
_ORDER_DAY = "CAST(o_orderdate AS DATE) + INTERVAL 24 YEAR"


@query(
    "day_type",
    f"""SELECT o_orderkey, d AS travel_date, CASE WHEN strftime(d, '%Y-%m-%d') IN ('2025-01-26', '2025-03-17', '2025-04-14',
  '2025-04-18', '2025-08-15', '2025-10-02', '2025-10-20', '2025-11-05', '2025-12-25') THEN 2
  WHEN dayofweek(d) IN (0, 6) THEN 1 ELSE 0 END AS day_type
FROM (SELECT o_orderkey, CAST({_ORDER_DAY} AS DATE) AS d FROM orders)""",
)
def day_type_query(spark, sf_dir) -> DataFrame:
    date = F.add_months(F.col("o_orderdate").cast("date"), 24 * 12)
    dated = px.table(spark, sf_dir, "orders").select("o_orderkey", date.alias("travel_date"))
    return dated.withColumn("day_type", day_type(F.col("travel_date")))


@query(
    "calendar_features",
    """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear(o_orderdate) AS INTEGER) AS week,
       CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS epoch_day FROM orders""",
)
def calendar_features(spark, sf_dir) -> DataFrame:
    date = F.col("o_orderdate").cast("date")
    parts = {**calendar_parts(date), "epoch_day": F.unix_date(date)}
    return px.table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


_ROLL_WINDOW = """OVER (PARTITION BY station ORDER BY datediff('day', DATE '1970-01-01', travel_date)
    RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)"""

# Row form of the rolling average: an independent statement of what the two-step form computes.
ENRICHED = f"""enriched AS (
  SELECT *, CASE WHEN rolling_72hr_avg_delay > {THRESHOLD} THEN 1 ELSE 0 END AS is_maintenance_likely FROM (
    SELECT event_id, train_number, station, travel_date, delay_min,
           CASE WHEN dayofweek(travel_date) IN (0, 6) THEN 1 ELSE 0 END AS day_type,
           coalesce(CAST(sum(delay_min) {_ROLL_WINDOW} AS DOUBLE) / nullif(count(delay_min) {_ROLL_WINDOW}, 0), 0.0)
             AS rolling_72hr_avg_delay
    FROM facts))"""


def enriched(spark, sf_dir) -> DataFrame:
    return enrich_facts(px.facts(spark, sf_dir), threshold=THRESHOLD)


@query(
    "rolling_delay",
    px.with_clause(px.FACTS, ENRICHED)
    + """SELECT event_id, station, travel_date, delay_min, day_type, rolling_72hr_avg_delay, is_maintenance_likely
FROM enriched""",
)
def rolling_delay(spark, sf_dir) -> DataFrame:
    return enriched(spark, sf_dir).select(
        "event_id", "station", "travel_date", "delay_min", "day_type", "rolling_72hr_avg_delay", "is_maintenance_likely"
    )


@query(
    "rolling_delay_2phase",
    px.with_clause(px.FACTS)
    + """SELECT a.station, a.travel_date,
       CAST(sum(b.delay_min) AS DOUBLE) / nullif(count(b.delay_min), 0) AS rolling_72hr_avg_delay,
       count(b.delay_min) AS history_count
FROM (SELECT DISTINCT station, travel_date FROM facts) a
LEFT JOIN facts b ON a.station = b.station AND datediff('day', b.travel_date, a.travel_date) BETWEEN 1 AND 3
GROUP BY a.station, a.travel_date""",
)
def rolling_delay_2phase(spark, sf_dir) -> DataFrame:
    return station_day_history(px.facts(spark, sf_dir))


@query(
    "topk_delays",
    """SELECT event_id, CAST(floor(value) AS INTEGER) AS delay_min FROM events
ORDER BY floor(value) DESC, event_id LIMIT 20""",
)
def topk_delays(spark, sf_dir) -> DataFrame:
    delays = px.table(spark, sf_dir, "events").select("event_id", F.floor("value").cast("int").alias("delay_min"))
    return top_rows(delays, 20, F.col("delay_min").desc(), F.col("event_id"))


@query(
    "delay_category",
    px.with_clause(px.FACTS)
    + """SELECT event_id, CASE WHEN delay_min IS NULL THEN NULL WHEN delay_min <= 15 THEN 'On Time'
  WHEN delay_min <= 60 THEN 'Slight Delay' ELSE 'Significant Delay' END AS delay_category FROM facts""",
)
def delay_category_query(spark, sf_dir) -> DataFrame:
    return px.facts(spark, sf_dir).select("event_id", delay_category(F.col("delay_min")).alias("delay_category"))


DELAY_TEXT_SQL = """CASE CAST(l_linenumber % 5 AS INTEGER) WHEN 0 THEN 'On Time' WHEN 1 THEN 'On Time / 0 Min'
    WHEN 2 THEN CAST(l_quantity AS INTEGER) || ' Min'
    WHEN 3 THEN printf('%02d:%02d Hr', CAST(l_quantity AS INTEGER) % 24, CAST(l_partkey % 60 AS INTEGER)) ELSE 'N/A' END"""


@query(
    "delay_text_minutes",
    """SELECT delay_text, CAST(CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN l_quantity
    WHEN 3 THEN (CAST(l_quantity AS INTEGER) % 24) * 60 + l_partkey % 60 END AS INTEGER) AS minutes, count(*) AS n
FROM (SELECT *, """
    + DELAY_TEXT_SQL
    + " AS delay_text FROM lineitem) GROUP BY ALL",
)
def delay_text_minutes(spark, sf_dir) -> DataFrame:
    kind, quantity = F.col("l_linenumber") % 5, F.col("l_quantity").cast("int")
    text = (
        F.when(kind == 0, "On Time")
        .when(kind == 1, "On Time / 0 Min")
        .when(kind == 2, F.format_string("%d Min", quantity))
        .when(kind == 3, F.format_string("%02d:%02d Hr", quantity % 24, F.col("l_partkey") % 60))
        .otherwise("N/A")
    )
    texts = px.table(spark, sf_dir, "lineitem").select(text.alias("delay_text"))
    return (
        texts.groupBy("delay_text")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("delay_text", delay_minutes(F.col("delay_text")).alias("minutes"), "n")
    )


@query(
    "weather_risk",
    "SELECT event_id, "
    + px.RISK_SQL.format(c="CAST(json_extract_string(props, '$.k') AS INTEGER)")
    + " AS weather_risk_score FROM events",
)
def weather_risk_query(spark, sf_dir) -> DataFrame:
    code = F.get_json_object("props", "$.k").cast("int")
    return px.table(spark, sf_dir, "events").select("event_id", weather_risk(code).alias("weather_risk_score"))


_NEAREST = """cells AS (
  SELECT *, round(latitude, 2) + 0.0 AS lat, round(longitude, 2) + 0.0 AS lon FROM stations),
one AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY
  (latitude - lat) * (latitude - lat) + (longitude - lon) * (longitude - lon), station_code) = 1),
nearest AS (
  SELECT w.vec_id, w.latitude, w.longitude, s.station_code, s.station_name FROM weather_points w LEFT JOIN one s
  ON round(w.latitude, 2) + 0.0 = s.lat AND round(w.longitude, 2) + 0.0 = s.lon)"""


def nearest(spark, sf_dir) -> DataFrame:
    return attach_stations(px.weather_points(spark, sf_dir), px.stations(spark, sf_dir))


_EVERY_MATCH = """nearest AS (
  SELECT w.vec_id, w.latitude, w.longitude, s.station_code, s.station_name FROM weather_points w LEFT JOIN stations s
  ON round(w.latitude, 2) + 0.0 = round(s.latitude, 2) + 0.0 AND round(w.longitude, 2) + 0.0 = round(s.longitude, 2) + 0.0)"""


@query("nearest_by_rounding", px.with_clause(px.POINTS, _EVERY_MATCH) + "SELECT * FROM nearest")
def nearest_by_rounding(spark, sf_dir) -> DataFrame:
    """Every station of a weather point's rounded coordinates, as the surveyed rule has it."""
    return attach_stations(px.weather_points(spark, sf_dir), px.stations(spark, sf_dir), matches="all")


@query(
    "match_coverage",
    px.with_clause(px.POINTS, _NEAREST)
    + """SELECT count(*) AS total_rows, count(station_code) AS matched_rows, count(*) - count(station_code) AS unmatched_rows,
       round(count(station_code) * 100.0 / count(*), 1)::DOUBLE AS matched_percent FROM nearest""",
)
def match_coverage_query(spark, sf_dir) -> DataFrame:
    return match_coverage(nearest(spark, sf_dir), "station_code")


@query(
    "coverage_by_station",
    px.with_clause(px.WEATHER)
    + f"""SELECT station_code, count(*) AS weather_records, min(weather_date) AS from_date, max(weather_date) AS to_date
FROM weather WHERE station_code IN ({', '.join(repr(s) for s in RECENT)}) GROUP BY station_code""",
)
def coverage_by_station(spark, sf_dir) -> DataFrame:
    return station_coverage(px.weather(spark, sf_dir), RECENT)


_DAILY = """daily AS (
  SELECT weather_date, CAST(sum(weather_code) AS DOUBLE) / count(weather_code) AS avg_weather_code,
         CAST(sum(precipitation_mm) AS DOUBLE) / count(precipitation_mm) AS avg_precipitation_mm,
         CAST(sum(weather_risk_score) AS DOUBLE) / count(weather_risk_score) AS avg_weather_risk_score
  FROM weather GROUP BY weather_date)"""


@query("daily_average", px.with_clause(px.WEATHER, _DAILY) + "SELECT * FROM daily")
def daily_average(spark, sf_dir) -> DataFrame:
    return daily_weather(px.weather(spark, sf_dir))


MEANS = """means AS (SELECT station_code, weather_date, CAST(sum(weather_code) AS DOUBLE) / count(weather_code) AS weather_code,
  CAST(sum(precipitation_mm) AS DOUBLE) / count(precipitation_mm) AS precipitation_mm,
  CAST(sum(weather_risk_score) AS DOUBLE) / count(weather_risk_score) AS weather_risk_score FROM weather GROUP BY ALL)"""

BACKFILLED = """filled AS (
  SELECT f.*, coalesce(w.weather_code, d.avg_weather_code, 0) AS weather_code,
         coalesce(w.precipitation_mm, d.avg_precipitation_mm, 0) AS precipitation_mm,
         coalesce(w.weather_risk_score, d.avg_weather_risk_score, 0) AS weather_risk_score
  FROM {facts} f LEFT JOIN means w ON f.station = w.station_code AND f.travel_date = w.weather_date
       LEFT JOIN daily d ON f.travel_date = d.weather_date)"""

WEATHER_CTES = (px.WEATHER, _DAILY, MEANS)


@query(
    "weather_backfill",
    px.with_clause(px.FACTS, *WEATHER_CTES, BACKFILLED.format(facts="facts")) + "SELECT * FROM filled",
)
def weather_backfill(spark, sf_dir) -> DataFrame:
    """As many rows as facts: the weather of a station and date is averaged first."""
    return backfill_weather(px.facts(spark, sf_dir), px.weather(spark, sf_dir))


@query(
    "weather_backfill_deduped",
    px.with_clause(px.FACTS, ENRICHED, *WEATHER_CTES, BACKFILLED.format(facts="enriched"))
    + """SELECT event_id, train_number, station, travel_date, delay_min, day_type, rolling_72hr_avg_delay,
       is_maintenance_likely, weather_code, precipitation_mm, weather_risk_score FROM filled""",
)
def weather_backfill_deduped(spark, sf_dir) -> DataFrame:
    """The whole fact table of the delay model: history, maintenance flag and weather."""
    return full_facts(spark, sf_dir)


def full_facts(spark, sf_dir) -> DataFrame:
    return backfill_weather(enriched(spark, sf_dir), px.weather(spark, sf_dir), dedupe="mean")


# Lookup features: averages of exact values, so both engines divide the same sums.
LOOKUP_SQL = """lookup AS (
  SELECT train_number, station, CAST(sum(delay_min) AS DOUBLE) / nullif(count(delay_min), 0) AS delay_min,
         CAST(sum(CAST(round(rolling_72hr_avg_delay, 2) AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS rolling_72hr_avg_delay,
         max(is_maintenance_likely) AS is_maintenance_likely
  FROM enriched GROUP BY train_number, station)"""


def lookup(spark, sf_dir) -> DataFrame:
    facts = enriched(spark, sf_dir).withColumn(
        "rolling_72hr_avg_delay", F.round("rolling_72hr_avg_delay", 2).cast("decimal(18,2)")
    )
    return station_lookup(facts, ["delay_min", "rolling_72hr_avg_delay"])


@query("station_lookup", px.with_clause(px.FACTS, ENRICHED, LOOKUP_SQL) + "SELECT * FROM lookup")
def station_lookup_query(spark, sf_dir) -> DataFrame:
    return lookup(spark, sf_dir)


@query(
    "network_size",
    px.with_clause(px.FACTS)
    + "SELECT count(DISTINCT train_number) AS n_trains, count(DISTINCT station) AS n_stations FROM facts",
)
def network_size_query(spark, sf_dir) -> DataFrame:
    return network_size(px.facts(spark, sf_dir))


@query("distinct_pairs", px.with_clause(px.FACTS) + "SELECT DISTINCT train_number, station FROM facts")
def distinct_pairs_query(spark, sf_dir) -> DataFrame:
    return distinct_pairs(px.facts(spark, sf_dir))


@query(
    "train_stations",
    px.with_clause(px.FACTS) + "SELECT DISTINCT train_number, station FROM facts WHERE train_number = 10002",
)
def train_stations(spark, sf_dir) -> DataFrame:
    return distinct_pairs(px.facts(spark, sf_dir), train=10002)


# Layout of the supplied pages: list items and paragraphs are cards; a paragraph that is not
# closed has no arrival part, and a bold unclosed one is therefore a divider.
PAGE = CardLayout(
    card=r"<(?:li|p)>",
    name=r"^<a [^>]*>([^<]+)<",
    arrival=r"</p>|</li>",
    delay=r'<a href="/([^"]*)"',
)

CARDS_SQL = """cards AS (
  SELECT page_id, position, CASE WHEN regexp_matches(card, '^<a [^>]*>([^<]+)<') THEN
           trim(replace(regexp_extract(card, '^<a [^>]*>([^<]+)<', 1), '&amp;', '&'), E' \\t\\n\\r') ELSE 'N/A' END AS station_name,
         CASE WHEN regexp_matches(card, '<a href="/([^"]*)"') THEN
                trim(replace(regexp_extract(card, '<a href="/([^"]*)"', 1), '&amp;', '&'), E' \\t\\n\\r')
              WHEN regexp_matches(card, '</p>|</li>') THEN 'On Time / 0 Min' ELSE 'N/A' END AS delay
  FROM (SELECT page_id, CAST(i - 1 AS INTEGER) AS position, pieces[i] AS card
        FROM (SELECT page_id, pieces, unnest(range(2, len(pieces) + 1)) AS i
              FROM (SELECT page_id, string_split_regex(html, '<(?:li|p)>') AS pieces FROM pages))))"""


@query("page_cards", px.with_clause(CARDS_SQL) + "SELECT * FROM cards")
def page_cards_query(spark, sf_dir) -> DataFrame:
    return page_cards(px.table(spark, sf_dir, "pages"), "page_id", layout=PAGE)


BLOCKS_SQL = """blocks AS (
  SELECT *, CAST(sum(CASE WHEN station_name = 'N/A' AND delay = 'N/A' THEN 1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_block FROM cards)"""


def blocks(spark, sf_dir) -> DataFrame:
    cards = page_cards(px.table(spark, sf_dir, "pages"), "page_id", layout=PAGE)
    return run_blocks(cards, "page_id", "position", divider())


@query("run_blocks", px.with_clause(CARDS_SQL, BLOCKS_SQL) + "SELECT * FROM blocks")
def run_blocks_query(spark, sf_dir) -> DataFrame:
    return blocks(spark, sf_dir)


@query(
    "kept_blocks",
    px.with_clause(CARDS_SQL, BLOCKS_SQL)
    + "SELECT * FROM blocks WHERE run_block IN (0, 1, 2) AND station_name <> 'N/A'",
)
def kept_blocks(spark, sf_dir) -> DataFrame:
    return keep_blocks(blocks(spark, sf_dir), [0, 1, 2])
