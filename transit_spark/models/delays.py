"""The delay forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from transit_spark.functions.calendar import calendar_parts
from transit_spark.models.store import ModelStore, ScoringModel, run_name
from transit_spark.operators.joins import join_counted
from transit_spark.operators.metrics import regression_metrics
from transit_spark.operators.ordered import dense_codes
from transit_spark.plans.delays import FEATURES
from transit_spark.session import stage

# Size of the delay forest.
FOREST_NAME = "DelayForest"
FOREST = {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 5, "featureSubsetStrategy": "all", "seed": 42}


def delay_training_set(facts: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with a known delay and all features, and the station codes they use."""
    known = facts.filter(F.col("delay_min").isNotNull()).withColumns(calendar_parts(F.col("travel_date")))
    codes = stage(dense_codes(known, "station", "station_enc"))
    rows = join_counted(known, codes, "station")
    return rows.select(*keep, "station", "travel_date", "delay_min", *FEATURES), codes


def fit_delay_model(train: DataFrame, features: Sequence[str] = FEATURES, **size) -> PipelineModel:
    forest = RandomForestRegressor(labelCol="delay_min", **{**FOREST, **size})
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, forest]).fit(train)


def stored_delay_model(store: ModelStore, train: DataFrame, codes: DataFrame, key: str) -> tuple[PipelineModel, DataFrame]:
    """The forest of these rows and its station codes, from the store where it has them, else fitted and stored."""
    run = "delay-" + run_name(train, [key, "delay_min", *FEATURES], FOREST)
    if FOREST_NAME not in store.candidates(run):
        model = fit_delay_model(train)
        codes.write.mode("overwrite").parquet(f"{store.place(run, FOREST_NAME)}/station-codes")
        ends = train.agg(F.min("delay_min"), F.max("delay_min")).first()
        rows = [("param", name, str(value)) for name, value in FOREST.items()]
        rows += [("label", "min", str(ends[0])), ("label", "max", str(ends[1]))]
        store.keep(run, FOREST_NAME, ScoringModel(None, model), rows)
    model = store.load(run, FOREST_NAME).model
    return model, store.spark.read.parquet(f"{store.place(run, FOREST_NAME)}/station-codes")


def evaluate_delay_model(model: PipelineModel, test: DataFrame) -> DataFrame:
    return regression_metrics(model.transform(test), "delay_min", "prediction")
