"""Delay history documents: one matrix of dates by stations per train."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from transit_spark.functions.calendar import date_from_parts
from transit_spark.schemas import DELAY_DOCUMENT


def read_delay_documents(spark: SparkSession, path: str, json_lines: bool = True) -> DataFrame:
    """Documents from JSON Lines, which Spark splits, or from files that hold one array each.

    A file holding one array is read by one task; many such files are read in parallel.
    """
    return spark.read.schema(DELAY_DOCUMENT).option("multiLine", not json_lines).json(path)


def read_document_records(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON Lines files, broken ones included: those have only ``broken_text`` and their file.

    Broken is a line that is no JSON object, and one whose fields have another form than a document's.
    """
    schema = StructType([*DELAY_DOCUMENT.fields, StructField("broken_text", StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken_text")
    return reader.json(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, and reject rows in the form of ``rejected_cells`` for what cannot be read as one.

    A record without a number or without data rows is a reject as well, since no fact could come of it.
    """
    size = F.coalesce(F.size("data"), F.lit(0))
    reason = (
        F.when(F.col("broken_text").isNotNull(), "document")
        .when(F.col("Number").try_cast("int").isNull(), "train number")
        .when(size < 2, "no data")
    )
    marked = records.withColumn("reason", reason)
    documents = marked.filter(F.col("reason").isNull()).select(*DELAY_DOCUMENT.names)
    text = F.coalesce("broken_text", F.to_json(F.struct(*DELAY_DOCUMENT.names)))
    rejects = marked.filter(F.col("reason").isNotNull()).select(
        F.col("Number").try_cast("int").alias("train_number"), "file_name", text.alias("record"), "reason"
    )
    return documents, rejects


def header_label(cell: Column) -> Column:
    """Header text; an object cell gives its label."""
    return F.coalesce(F.get_json_object(F.when(cell.startswith("{"), cell), "$.label"), cell)


def _whole_minutes(cell: Column) -> Column:
    """A number as whole minutes, fractions cut off; NULL for other text."""
    return F.coalesce(cell.try_cast("int"), cell.try_cast("double").try_cast("int"))


def unpivot_documents(documents: DataFrame) -> DataFrame:
    """One row per train, data row and cell, cells paired with the header by position.

    The header stays an array that is indexed per cell, so no join or shuffle is
    needed. Cells beyond the header and header cells beyond a short row are
    dropped. ``travel_date`` is NULL where the date text is no date.
    """
    rows = documents.select(
        F.col("Number").try_cast("int").alias("train_number"),
        F.col("Name").alias("train_name"),
        F.try_element_at("data", F.lit(1)).alias("header"),
        F.explode(F.slice("data", 2, F.greatest(F.size("data") - 1, F.lit(0)))).alias("cells"),
    ).withColumn("date_text", F.try_element_at("cells", F.lit(1)))
    return (
        rows.withColumn("travel_date", date_from_parts(F.col("date_text")))
        .select(
            "train_number",
            "train_name",
            "travel_date",
            "date_text",
            "header",
            F.posexplode("cells").alias("position", "cell"),
        )
        .filter((F.col("position") > 0) & (F.col("position") < F.size("header")))
        .select(
            "train_number",
            "train_name",
            header_label(F.col("header")[F.col("position")]).alias("station"),
            _whole_minutes(F.col("cell")).alias("delay_min"),
            "travel_date",
            "date_text",
            F.col("cell").alias("delay_text"),
        )
    )


def delay_facts(documents: DataFrame) -> DataFrame:
    """The fact table: cells with a valid date and a whole number or NULL as delay."""
    cells = unpivot_documents(documents)
    return cells.filter(~_rejected()).select(
        "train_number",
        "train_name",
        "station",
        "delay_min",
        "travel_date",
        F.current_timestamp().alias("ingested_at"),
    )


def rejected_cells(documents: DataFrame) -> DataFrame:
    """What ``delay_facts`` leaves out, with the original text and the reason."""
    bad_date = F.col("travel_date").isNull()
    return (
        unpivot_documents(documents)
        .filter(_rejected())
        .select(
            "train_number",
            "station",
            "date_text",
            "delay_text",
            F.when(F.col("train_number").isNull(), "train number").when(bad_date, "date").otherwise("delay").alias("reason"),
        )
    )


def rejected_rows(documents: DataFrame) -> DataFrame:
    """Data rows, not cells, whose date text is no date."""
    return (
        documents.select(
            F.col("Number").try_cast("int").alias("train_number"),
            F.explode(F.slice("data", 2, F.greatest(F.size("data") - 1, F.lit(0)))).alias("cells"),
        )
        .select("train_number", F.try_element_at("cells", F.lit(1)).alias("date_text"))
        .filter(F.coalesce(date_from_parts(F.col("date_text")).isNull(), F.lit(True)))
    )


def _rejected() -> Column:
    text_delay = F.col("delay_text").isNotNull() & F.col("delay_min").isNull()
    return F.col("train_number").isNull() | F.col("travel_date").isNull() | text_delay
