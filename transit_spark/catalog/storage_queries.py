"""Sources, sinks and the ingestion chain, as round trips below the shared folder."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from transit_spark.catalog import booking_queries as bq, delay_queries as dq, proxies as px
from transit_spark.catalog.registry import Registry
from transit_spark.plans.delays import build_delay_facts
from transit_spark.session import checkpoint_root
from transit_spark.sinks import snapshots, tables as sinks
from transit_spark.sources import csv_tables, tables as sources
from transit_spark.sources.delay_documents import read_document_records, rejected_cells, split_records

REGISTRY = Registry()
query = REGISTRY.query

_FACT_COLUMNS = ("event_id", "train_number", "station", "travel_date", "delay_min")


def folder(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def database(spark: SparkSession) -> str:
    """A database whose managed tables lie below the shared folder."""
    name = "transit_" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder(spark, 'database')}'")
    return name


# --- documents ----------------------------------------------------------------------------------

_BROKEN = """'{"Number":"' || train_number || '","Name":'"""
_MISNAMED = """'{"Number":"T' || train_number || '","Name":"x","data":[["Date","A"],["2024,1,1","5"]]}'"""


def written_records(spark, sf_dir) -> DataFrame:
    """The documents of every train and month as JSON Lines, written and read back.

    Every tenth train also has a line that breaks off, every fifteenth one whose number is no number.
    """
    documents = dq.delay_documents(spark, sf_dir)
    lines = documents.select(F.to_json(F.struct("Number", "Name", "data"), {"ignoreNullFields": "false"}).alias("document"))
    trains = px.facts(spark, sf_dir).select("train_number").distinct()
    odd = F.array(
        F.when(F.col("train_number") % 20 == 0, F.expr(_BROKEN)), F.when(F.col("train_number") % 30 == 0, F.expr(_MISNAMED))
    )
    bad = trains.select(F.explode(F.array_compact(odd)).alias("document"))
    path = folder(spark, "documents")
    sinks.export_documents(lines.unionByName(bad), path)
    return read_document_records(spark, path)


_CELLS = dq.MATRIX_SQL + """,
chain_cells AS (
  SELECT s.train_number, s.station, d.travel_date, w.delay_min
  FROM s JOIN d USING (train_number, in_month) LEFT JOIN worst w
    ON w.train_number = s.train_number AND w.station = s.station AND w.travel_date = d.travel_date
  UNION ALL SELECT train_number, min(station), DATE '2023-12-31', 7 FROM s GROUP BY train_number, in_month)"""

_CHAIN_WINDOW = """OVER (PARTITION BY station ORDER BY datediff('day', DATE '1970-01-01', travel_date)
    RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)"""
_CHAIN = f"""chain AS (
  SELECT *, CASE WHEN rolling_72hr_avg_delay > 15 THEN 1 ELSE 0 END AS is_maintenance_likely FROM (
    SELECT train_number, station, travel_date, delay_min, CASE WHEN dayofweek(travel_date) IN (0, 6) THEN 1 ELSE 0 END AS day_type,
           coalesce(CAST(sum(delay_min) {_CHAIN_WINDOW} AS DOUBLE) / nullif(count(delay_min) {_CHAIN_WINDOW}, 0), 0.0) AS rolling_72hr_avg_delay
    FROM chain_cells))"""

_CHAIN_COLUMNS = (
    "train_number", "station", "travel_date", "delay_min", "day_type", "rolling_72hr_avg_delay", "is_maintenance_likely",
    "weather_code", "precipitation_mm", "weather_risk_score",
)


@query(
    "ingestion_chain",
    px.with_clause(px.FACTS, _CELLS, _CHAIN, *dq.WEATHER_CTES, dq.BACKFILLED.format(facts="chain"))
    + f"SELECT {', '.join(_CHAIN_COLUMNS)} FROM filled",
)
def ingestion_chain(spark, sf_dir) -> DataFrame:
    """Document files to the enriched fact table, one published version for each step."""
    documents, _ = split_records(written_records(spark, sf_dir))
    root = folder(spark, "facts")
    facts = build_delay_facts(documents, px.weather(spark, sf_dir), root, "chain_" + uuid.uuid4().hex)
    return facts.select(*_CHAIN_COLUMNS)


@query(
    "publish_log",
    px.with_clause(px.FACTS, _CELLS)
    + """SELECT v.version::BIGINT AS version, v.operation, (SELECT count(*) FROM chain_cells) AS n_rows
FROM (VALUES (0, 'INGEST'), (1, 'ENRICH'), (2, 'WEATHER')) v(version, operation)""",
)
def publish_log(spark, sf_dir) -> DataFrame:
    """The newest five versions of the fact table, with the rows of each."""
    documents, _ = split_records(written_records(spark, sf_dir))
    root = folder(spark, "facts")
    build_delay_facts(documents, px.weather(spark, sf_dir), root, "chain_" + uuid.uuid4().hex)
    log = snapshots.history(spark, root)
    sizes = [
        snapshots.current_snapshot(spark, root, r.version).agg(F.lit(r.version).alias("version"), F.count(F.lit(1)).alias("n_rows"))
        for r in log.collect()
    ]
    counted = sizes[0]
    for size in sizes[1:]:
        counted = counted.unionByName(size)
    return log.join(counted, "version").select("version", "operation", "n_rows")


@query(
    "document_rejects",
    px.with_clause(px.FACTS)
    + f"""SELECT NULL::INTEGER AS train_number, {_BROKEN} AS record, 'document' AS reason
FROM (SELECT DISTINCT train_number FROM facts WHERE train_number % 20 = 0)
UNION ALL SELECT NULL, {_MISNAMED}, 'train number' FROM (SELECT DISTINCT train_number FROM facts WHERE train_number % 30 = 0)""",
)
def document_rejects(spark, sf_dir) -> DataFrame:
    """Lines that are no document, with their text and the reason."""
    return split_records(written_records(spark, sf_dir))[1].select("train_number", "record", "reason")


@query(
    "cell_rejects",
    px.with_clause(px.FACTS, dq.MATRIX_SQL)
    + "SELECT train_number, station, '2024,2,30' AS date_text, '1' AS delay_text, 'date' AS reason FROM s",
)
def cell_rejects(spark, sf_dir) -> DataFrame:
    """Cells of good documents that are no facts."""
    return rejected_cells(split_records(written_records(spark, sf_dir))[0])


# --- tables -------------------------------------------------------------------------------------

_COLUMNS_SQL = ", ".join(_FACT_COLUMNS)


@query(
    "managed_table_round_trip",
    px.with_clause(px.FACTS)
    + """SELECT event_id, train_number, station, travel_date,
  CASE WHEN day(travel_date) % 5 = 0 THEN delay_min + 1000 ELSE delay_min END AS delay_min
FROM facts WHERE travel_date >= DATE '2024-01-04'""",
)
def managed_table_round_trip(spark, sf_dir) -> DataFrame:
    """A managed table by date, of which every fifth date is replaced, read from a date on."""
    name = f"{database(spark)}.facts"
    facts = px.facts(spark, sf_dir).select(*_FACT_COLUMNS)
    sinks.publish_table(facts, name, partition_by="travel_date")
    late = facts.filter(F.day("travel_date") % 5 == 0).withColumn("delay_min", F.col("delay_min") + 1000)
    sinks.replace_table_dates(late, name)
    return sources.read_table(spark, name, _FACT_COLUMNS, date_from=dt.date(2024, 1, 4))


@query("path_table_round_trip", px.with_clause(px.BOOKINGS, px.SILVER) + 'SELECT "PNR", "Class", "Fare", "Distance", label FROM silver')
def path_table_round_trip(spark, sf_dir) -> DataFrame:
    """Silver bookings as a folder, named in the catalog and read by that name."""
    path, name = folder(spark, "silver"), f"{database(spark)}.silver"
    sinks.publish_path(bq.silver(spark, sf_dir).select("PNR", "Class", "Fare", "Distance", "label"), path)
    sinks.register_external(spark, name, path)
    return sources.read_table(spark, name)


@query("csv_round_trip", px.with_clause(px.FACTS) + f"SELECT {_COLUMNS_SQL} FROM facts")
def csv_round_trip(spark, sf_dir) -> DataFrame:
    """Facts exported as CSV and read with a schema."""
    facts = px.facts(spark, sf_dir).select(*_FACT_COLUMNS)
    path = folder(spark, "csv")
    sinks.export_csv(facts, path)
    return csv_tables.read_csv(spark, path, facts.schema)


@query(
    "csv_inferred",
    px.with_clause(px.FACTS) + "SELECT station, min(travel_date) AS first_date, count(delay_min) AS n, sum(delay_min)::BIGINT AS total FROM facts GROUP BY station",
)
def csv_inferred(spark, sf_dir) -> DataFrame:
    """The same files read with inferred types, totalled by station."""
    path = folder(spark, "csv")
    sinks.export_csv(px.facts(spark, sf_dir).select(*_FACT_COLUMNS), path)
    inferred = csv_tables.read_csv(spark, path)
    return inferred.groupBy("station").agg(
        F.min("travel_date").alias("first_date"), F.count("delay_min").alias("n"), F.sum("delay_min").alias("total")
    )
