import random

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from transit_spark.operators.metrics import area_under_roc, best_candidate, classification_metrics, describe, regression_metrics


def scored(spark, n=2000, seed=4):
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        label = float(rng.random() < 0.3)
        score = round(min(max(rng.gauss(0.4 + 0.2 * label, 0.2), 0.0), 1.0), 2)
        data.append((label, score, float(score > 0.5), "m" if rng.random() < 0.3 else "w"))
    return spark.createDataFrame(data, "label DOUBLE, score DOUBLE, prediction DOUBLE, model STRING")


def test_auc_equals_evaluator(spark):
    df = scored(spark)
    want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert abs(area_under_roc(df, "label", "score").first().auc - want) < 1e-9
    by_model = {r.model: r.auc for r in area_under_roc(df, "label", "score", ["model"]).collect()}
    for model, auc in by_model.items():
        part = df.filter(F.col("model") == model)
        assert abs(auc - BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(part)) < 1e-9


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 0.7)], "label DOUBLE, score DOUBLE")
    assert area_under_roc(df, "label", "score").first().auc is None


def test_classification_equals_evaluator(spark):
    df = scored(spark)
    got = classification_metrics(df, "label", "prediction").first()
    assert got.n == 2000
    assert abs(got.accuracy - MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df)) < 1e-12
    assert abs(got.f1 - MulticlassClassificationEvaluator(metricName="f1").evaluate(df)) < 1e-12
    three = df.withColumn("label", F.when(F.col("score") > 0.8, 2.0).otherwise(F.col("label")))
    got = classification_metrics(three, "label", "prediction").first()
    assert abs(got.f1 - MulticlassClassificationEvaluator(metricName="f1").evaluate(three)) < 1e-12


def test_regression_equals_evaluator(spark):
    df = scored(spark)
    got = regression_metrics(df, "label", "score").first()
    for name in ("rmse", "mae", "r2"):
        want = RegressionEvaluator(labelCol="label", predictionCol="score", metricName=name).evaluate(df)
        assert abs(got[name] - want) < 1e-9
    missing = df.withColumn("score", F.when(F.col("model") == "m", F.col("score")))
    assert regression_metrics(missing, "label", "score").first().n == df.filter("model = 'm'").count()


def test_best_candidate(spark, rows):
    df = spark.createDataFrame([("RF", 0.8), ("GBT", 0.9), ("LR", 0.9), ("X", None)], "candidate STRING, auc DOUBLE")
    assert rows(best_candidate(df)) == [("GBT", 0.9)]


def test_describe_equals_pandas(spark):
    df = scored(spark, 501).withColumn("label", F.when(F.col("model") == "m", F.col("label")))
    want = df.select("label", "score").toPandas().describe()
    for r in describe(df, ["label", "score"]).collect():
        assert abs(r.value - want[r["column"]][r.stat]) < 1e-9, r
