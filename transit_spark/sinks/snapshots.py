"""Versions of a table: write a new folder, claim the next version number for it, and point a view at it.

A parquet folder cannot be replaced by a query that reads it. A snapshot never overwrites: readers keep the version
they started with. Any number of writers may publish at the same time: a version is one small file that its writer
creates only if it is not there, so two writers never get one number, and the later one takes the next.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from transit_spark.schemas import PUBLISH_LOG
from transit_spark.sinks.tables import publish_path


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; False if it is there already.

    The file system decides: an object store or HDFS by creating without overwriting, a folder of this machine by an
    exclusive open.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(place).toString()
    if full.startswith("file:"):
        local = unquote(urlparse(full).path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = system.create(place, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def publish_log(spark: SparkSession, root: str) -> DataFrame:
    """One row for each version; none before the first."""
    try:
        rows = spark.read.schema(PUBLISH_LOG).json(f"{root}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PUBLISH_LOG)
    # A writer lost between creating its file and filling it leaves an empty one, which reads as no row.
    return rows.filter(F.col("path").isNotNull())


def history(spark: SparkSession, root: str, n: int = 5) -> DataFrame:
    """The newest ``n`` versions."""
    newest = publish_log(spark, root).select("version", "timestamp", "operation").orderBy(F.col("version").desc())
    return newest.limit(n)


def current_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The newest version, or the one named; None where there is none."""
    log = publish_log(spark, root)
    wanted = log if version is None else log.filter(F.col("version") == version)
    newest = wanted.orderBy(F.col("version").desc()).first()
    return spark.read.parquet(newest.path) if newest else None


def claim_version(spark: SparkSession, root: str, path: str, operation: str) -> int:
    """Log ``path`` under the first free number after the newest version, and return that number."""
    newest = publish_log(spark, root).agg(F.max("version")).first()[0]
    version = -1 if newest is None else newest
    while True:
        version += 1
        stamp = dt.datetime.now(dt.timezone.utc).isoformat(timespec="milliseconds")
        entry = {"version": version, "timestamp": stamp, "operation": operation, "path": path}
        if put_if_absent(spark, f"{root}/versions/{version:012d}.json", json.dumps(entry) + "\n"):
            return version


def publish_snapshot(
    df: DataFrame, root: str, view: str | None = None, partition_by: str | None = None, operation: str = "WRITE"
) -> DataFrame:
    """Write ``df``, which may read an older snapshot, as the newest version and return it."""
    spark = df.sparkSession
    path = f"{root}/data/{uuid.uuid4().hex}"
    publish_path(df, path, partition_by)
    claim_version(spark, root, path, operation)
    published = spark.read.parquet(path)
    if view:
        published.createOrReplaceTempView(view)
    return published
