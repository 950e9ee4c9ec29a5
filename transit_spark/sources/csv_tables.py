"""CSV sources; all have a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from transit_spark import schemas


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """With a schema the files are read once; without one Spark reads them twice to infer it."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_weather(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    return read_csv(spark, path, None if infer else schemas.WEATHER_CSV)


def read_station_master(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.STATION_MASTER)


def read_bookings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.BOOKINGS)


def read_station_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.STATION_PAIRS)


def read_scraped_delays(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, schemas.SCRAPED_DELAYS)
    return raw.withColumnsRenamed({"Train Number": "train_number", "Station Name": "station", "Delay": "delay"})
