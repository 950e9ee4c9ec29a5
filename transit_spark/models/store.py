"""Fitted models and their metrics below one folder, kept by run and read again by later sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from transit_spark.models.features import Features, score_features
from transit_spark.session import checkpoint_root
from transit_spark.sinks.tables import append_new, read_appended

METRIC_LOG = "run STRING, candidate STRING, kind STRING, name STRING, value STRING"
LOG_KEY = ("run", "candidate", "kind", "name")


def run_name(rows: DataFrame, columns: Sequence[str], settings: object = None) -> str:
    """A name that follows from the rows, whatever their order and partitions, and from the settings."""
    code = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(code), F.lit(0))).first()
    return hashlib.sha256(repr((count, str(total), list(columns), repr(settings))).encode()).hexdigest()[:20]


@dataclass(frozen=True)
class ScoringModel:
    """Feature stages and model put together; ``features`` is None for a model that needs only its pipeline."""

    features: Features | None
    model: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        return score_features(self.model, self.features.transform(df)) if self.features else self.model.transform(df)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        if self.features:
            self.features.save(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str, with_features: bool = True) -> ScoringModel:
        features = Features.load(spark, f"{path}/features") if with_features else None
        return ScoringModel(features, PipelineModel.load(f"{path}/model"))


class ModelStore:
    """Models of many runs, the log of their metrics and parameters, and the choice of the best from that log.

    A candidate is listed as a model only after all of it has been written, so a run that broke off is fitted anew.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{checkpoint_root(spark)}/models"

    def log(self) -> DataFrame:
        """Every logged row once, whatever the number of reruns."""
        return read_appended(self.spark, f"{self.root}/log", METRIC_LOG, LOG_KEY)

    def record(self, rows: Sequence[tuple]) -> None:
        """Append rows of the log that are not there yet."""
        append_new(self.spark.createDataFrame(list(rows), METRIC_LOG), f"{self.root}/log", LOG_KEY)

    def place(self, run: str, candidate: str) -> str:
        return f"{self.root}/{run}/{candidate}"

    def candidates(self, run: str) -> list[str]:
        """Names of the run's candidates that can be loaded."""
        listed = self.log().filter((F.col("run") == run) & (F.col("kind") == "model")).select("candidate")
        return sorted(r.candidate for r in listed.collect())

    def keep(self, run: str, candidate: str, model: ScoringModel, rows: Sequence[tuple[str, str, str]]) -> None:
        """Write a model, then its log rows ``(kind, name, value)``."""
        path = self.place(run, candidate)
        model.save(path)
        with_features = "features" if model.features else "plain"
        self.record([(run, candidate, *r) for r in rows] + [(run, candidate, "model", with_features, path)])

    def load(self, run: str, candidate: str) -> ScoringModel:
        entry = self.log().filter((F.col("run") == run) & (F.col("candidate") == candidate) & (F.col("kind") == "model"))
        found = entry.first()
        if found is None:
            raise LookupError(f"run {run} has no model {candidate}")
        return ScoringModel.load(self.spark, found.value, found.name == "features")

    def ranking(self, run: str, metric: str = "auc_roc") -> DataFrame:
        """``(candidate, metric)`` of the run as logged, the best first, ties by name."""
        chosen = self.log().filter((F.col("run") == run) & (F.col("kind") == "metric") & (F.col("name") == metric))
        value = F.col("value").try_cast("double")
        return chosen.select("candidate", value.alias(metric)).filter(~F.isnan(metric)).orderBy(F.desc(metric), "candidate")

    def best(self, run: str, metric: str = "auc_roc") -> tuple[str, ScoringModel]:
        """Name and model of the candidate with the highest logged metric."""
        top = self.ranking(run, metric).first()
        if top is None:
            raise LookupError(f"run {run} has logged no {metric}")
        return top.candidate, self.load(run, top.candidate)
