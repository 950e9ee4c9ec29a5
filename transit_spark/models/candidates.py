"""Confirmation classifiers and the fare regressor: grids, cross-validation, metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from transit_spark.models.features import (
    CATEGORICAL,
    NUMERIC,
    Features,
    as_double,
    feature_names,
    fit_features,
    prepare,
    score_features,
)
from transit_spark.models.store import METRIC_LOG, ModelStore, ScoringModel, run_name
from transit_spark.operators.encode import FOLD, hash_bucket

SEED = 42
FARE_NUMERIC = tuple(c for c in NUMERIC if c != "Fare")


@dataclass
class Candidate:
    name: str
    estimator: object
    grid: list


@dataclass
class Fitted:
    """A fitted candidate: the features it needs, the best model, and its metrics."""

    name: str
    features: Features
    model: Model
    metrics: dict[str, float]

    @property
    def pipeline(self) -> ScoringModel:
        """Features and model put together, for scoring and saving."""
        return ScoringModel(self.features, PipelineModel([self.model]))

    def log_rows(self) -> list[tuple[str, str, str]]:
        """``(kind, name, value)`` of every metric and chosen parameter."""
        chosen = [("param", p.name, str(v)) for p, v in self.model.extractParamMap().items()]
        return [("metric", k, repr(v)) for k, v in self.metrics.items()] + chosen


def _grid(**values):
    builder = ParamGridBuilder()
    for param, options in values.values():
        builder = builder.addGrid(param, options)
    return builder.build()


def confirmation_candidates(full: bool = True) -> list[Candidate]:
    """The three classifiers with their grids; ``full=False`` gives small ones for trial runs."""
    # Sizes and grids of the candidate models.
    forest = RandomForestClassifier(numTrees=100, maxDepth=8, seed=SEED)
    boosted = GBTClassifier(maxIter=50, maxDepth=6, seed=SEED)
    logistic = LogisticRegression(maxIter=100, regParam=0.01)
    if not full:
        forest.setNumTrees(10).setMaxDepth(4)
        boosted.setMaxIter(4).setMaxDepth(3)
        logistic.setMaxIter(10)
        return [
            Candidate("RandomForest", forest, _grid(d=(forest.maxDepth, [3, 4]))),
            Candidate("GBT", boosted, _grid(s=(boosted.stepSize, [0.1]))),
            Candidate("LogisticRegression", logistic, _grid(r=(logistic.regParam, [0.001, 0.01]))),
        ]
    return [
        Candidate("RandomForest", forest, _grid(n=(forest.numTrees, [50, 100]), d=(forest.maxDepth, [6, 8]))),
        Candidate("GBT", boosted, _grid(n=(boosted.maxIter, [30, 50]), s=(boosted.stepSize, [0.05, 0.1]))),
        Candidate("LogisticRegression", logistic, _grid(r=(logistic.regParam, [0.001, 0.01]))),
    ]


def fare_candidate(full: bool = True) -> Candidate:
    # Size and grid of the fare model.
    forest = RandomForestRegressor(labelCol="Fare", numTrees=100, maxDepth=8, seed=SEED)
    if not full:
        forest.setNumTrees(10).setMaxDepth(4)
        return Candidate("FareForest", forest, _grid(m=(forest.minInstancesPerNode, [1, 2])))
    grid = _grid(
        n=(forest.numTrees, [50, 100]),
        d=(forest.maxDepth, [6, 8]),
        m=(forest.minInstancesPerNode, [1, 2]),
    )
    return Candidate("FareForest", forest, grid)


def _with_folds(df: DataFrame, key: str, folds: int) -> DataFrame:
    """The folds of the training set where it has them, since its route statistics belong to them."""
    return df if FOLD in df.columns else df.withColumn(FOLD, (hash_bucket(key) % folds).cast("int"))


def _side_by_side(train: DataFrame, parallelism: int) -> int:
    """How many fits run at once: as many as it takes to have ``parallelism`` tasks, since each keeps its rows in store."""
    return -(-parallelism // max(1, train.rdd.getNumPartitions()))


def _cross_validate(candidate: Candidate, train: DataFrame, evaluator, folds: int, parallelism: int) -> Model:
    if len(candidate.grid) == 1:
        return candidate.estimator.fit(train, candidate.grid[0])
    cv = CrossValidator(
        estimator=candidate.estimator,
        estimatorParamMaps=candidate.grid,
        evaluator=evaluator,
        numFolds=folds,
        foldCol=FOLD,
        seed=SEED,
        parallelism=_side_by_side(train, parallelism),
    )
    return cv.fit(train).bestModel


def fit_candidates(
    train: DataFrame,
    test: DataFrame,
    candidates: Sequence[Candidate] | None = None,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    folds: int = 3,
    parallelism: int = 4,
    center: bool = False,
    key: str = "PNR",
    widths: Mapping[str, int] | None = None,
) -> list[Fitted]:
    """Fit every candidate on the same prepared features and measure it on the test rows.

    Folds follow from the key of a row, so they do not depend on how the rows are
    spread over files and tasks.

    The feature stages are fitted once on all training rows and not per fold, so
    a fold's indexes, medians and scales have seen its held-out rows. The labels
    have not been used for them; those in route statistics are left out where the
    training set was made with ``fit_on="out_of_fold"``.
    """
    candidates = candidates or confirmation_candidates()
    train, test = as_double(train, numeric), as_double(test, numeric)
    features = fit_features(train, categorical, numeric, center=center, widths=widths)
    prepared = prepare(features, _with_folds(train, key, folds), ["label", FOLD])
    held_out = prepare(features, test, ["label"])
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC")
    fitted = []
    for candidate in candidates:
        model = _cross_validate(candidate, prepared, auc, folds, parallelism)
        fitted.append(Fitted(candidate.name, features, model, _classification_metrics(model, held_out)))
    return fitted


def _classification_metrics(model: Model, held_out: DataFrame) -> dict[str, float]:
    """Test metrics from plain numbers: the score of each row, and the count of each pair of label and prediction."""
    score = vector_to_array("rawPrediction")[1].alias("score")
    scored = score_features(model, held_out).select("label", "prediction", score).cache()
    counts = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).cast("double").alias("n"))
    metrics = {"auc_roc": BinaryClassificationEvaluator(rawPredictionCol="score", metricName="areaUnderROC").evaluate(scored)}
    for name, metric in (("accuracy", "accuracy"), ("f1_score", "f1")):
        metrics[name] = MulticlassClassificationEvaluator(metricName=metric, weightCol="n").evaluate(counts)
    scored.unpersist()
    return metrics


def fit_fare(
    train: DataFrame,
    test: DataFrame,
    candidate: Candidate | None = None,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = FARE_NUMERIC,
    folds: int = 3,
    parallelism: int = 4,
    center: bool = False,
    key: str = "PNR",
) -> Fitted:
    """The fare forest by RMSE, with its test metrics."""
    candidate = candidate or fare_candidate()
    train, test = as_double(train, [*numeric, "Fare"]), as_double(test, [*numeric, "Fare"])
    features = fit_features(train, categorical, numeric, center=center)
    prepared = prepare(features, _with_folds(train, key, folds), ["Fare", FOLD])
    held_out = prepare(features, test, ["Fare"])
    rmse = RegressionEvaluator(labelCol="Fare", metricName="rmse")
    model = _cross_validate(candidate, prepared, rmse, folds, parallelism)
    scored = score_features(model, held_out).select("Fare", "prediction").cache()
    metrics = {m: rmse.setMetricName(m).evaluate(scored) for m in ("rmse", "mae", "r2")}
    scored.unpersist()
    return Fitted(candidate.name, features, model, metrics)


def metric_log(spark: SparkSession, run: str, fitted: Sequence[Fitted]) -> DataFrame:
    """Metrics and chosen parameters as rows, ready to append to a table."""
    return spark.createDataFrame([(run, f.name, *row) for f in fitted for row in f.log_rows()], METRIC_LOG)


def stored_run(
    store: ModelStore,
    train: DataFrame,
    test: DataFrame,
    candidates: Sequence[Candidate],
    fit: Callable[[Sequence[Candidate]], Sequence[Fitted]],
    columns: Sequence[str],
) -> str:
    """The run of these candidates on these rows; fits and stores those that the log does not list yet.

    Its name follows from the rows and the candidates' settings, so a rerun, also of another session on the same
    store, finds its models and adds nothing.
    """
    settings = [(c.name, type(c.estimator).__name__, _texts(c.estimator.extractParamMap()), [_texts(g) for g in c.grid]) for c in candidates]
    run = run_name(train, columns, (settings, run_name(test, columns)))
    there = set(store.candidates(run))
    missing = [c for c in candidates if c.name not in there]
    for f in fit(missing) if missing else ():
        store.keep(run, f.name, f.pipeline, f.log_rows())
    return run


def _texts(params) -> list[tuple[str, str]]:
    return sorted((p.name, str(v)) for p, v in params.items())


def best_fitted(fitted: Sequence[Fitted], metric: str = "auc_roc") -> Fitted:
    return max(fitted, key=lambda f: f.metrics[metric])


def feature_importance(scoring: ScoringModel | Fitted, spark: SparkSession | None = None) -> DataFrame:
    """``(feature, importance)``, the largest first; one row per entry of the feature vector."""
    spark = spark or SparkSession.active()
    features = scoring.features
    model = scoring.model.stages[-1] if isinstance(scoring.model, PipelineModel) else scoring.model
    numbers = enumerate(model.featureImportances.toArray().tolist())
    rows = spark.createDataFrame(list(numbers), "position INT, importance DOUBLE")
    named = rows.join(feature_names(features.categories, features.numeric, spark), "position")
    return named.select("feature", "importance").orderBy(F.col("importance").desc(), "feature")


def infer_confirmations(scoring: ScoringModel, bookings: DataFrame) -> DataFrame:
    """Batch inference: truth, prediction and the two probabilities per booking."""
    scored = scoring.transform(bookings)
    return scored.select(
        "PNR", "FinalStatus", "label", "prediction", vector_to_array("probability").alias("probability")
    )


def infer_fares(scoring: ScoringModel, bookings: DataFrame) -> DataFrame:
    scored = scoring.transform(as_double(bookings, ["Fare"]))
    return scored.select("PNR", "Fare", "prediction").withColumnRenamed("prediction", "predicted_fare")


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
