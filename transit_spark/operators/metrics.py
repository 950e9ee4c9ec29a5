"""Model metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from transit_spark.operators.ordered import running_sum
from transit_spark.operators.percentiles import percentiles


def regression_metrics(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R squared; rows without label or prediction are left out."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    known = df.filter(y.isNotNull() & p.isNotNull())
    squared = F.sum((y - p) * (y - p))
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    return known.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(squared / n).alias("rmse"),
        (F.sum(F.abs(y - p)) / n).alias("mae"),
        (1 - squared / F.nullif(F.var_pop(y) * n, F.lit(0.0))).alias("r2"),
    )


def confusion_counts(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    return (
        df.groupBy(*groups, F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def classification_metrics(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy and F1 weighted by class size, from the confusion counts."""
    groups = list(groups)
    counts = confusion_counts(df, label, prediction, groups)
    # Each count adds to its true class, its predicted class and, when equal, to the hits.
    side = F.explode(
        F.array(
            F.struct(F.col("label").alias("cls"), F.col("n").alias("real"), F.lit(0).cast("bigint").alias("guessed")),
            F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("bigint").alias("real"), F.col("n").alias("guessed")),
        )
    )
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    per_class = (
        counts.select(*groups, hit.alias("hit"), side.alias("s"))
        .groupBy(*groups, "s.cls")
        .agg(F.sum("s.real").alias("real"), F.sum("s.guessed").alias("guessed"), (F.sum("hit") / 2).alias("hits"))
    )
    f1 = 2 * F.col("hits") / F.nullif(F.col("real") + F.col("guessed"), F.lit(0))
    return per_class.groupBy(*groups).agg(
        F.sum("real").alias("n"),
        (F.sum("hits") / F.sum("real")).alias("accuracy"),
        (F.sum(f1 * F.col("real")) / F.sum("real")).alias("f1"),
    )


def area_under_roc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks of the scores.

    Rows are first reduced to distinct scores; their ranks come from a
    distributed running count. NULL when a group has only one class.
    """
    groups = list(groups)
    by_score = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*groups, F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    ranked = running_sum(by_score, ["score"], {"upto": F.col("n")}, groups)
    # Whole numbers throughout: twice the average rank is 2 * upto - n + 1.
    twice_rank = (F.col("upto") * 2 - F.col("n") + 1).cast("decimal(19,0)")
    sums = ranked.groupBy(*groups).agg(
        F.sum(F.col("pos").cast("decimal(18,0)") * twice_rank).cast("double").alias("rank_sum"),
        F.sum("pos").cast("double").alias("p"),
        (F.sum("n") - F.sum("pos")).cast("double").alias("q"),
    )
    auc = (F.col("rank_sum") - F.col("p") * (F.col("p") + 1)) / F.nullif(2 * F.col("p") * F.col("q"), F.lit(0.0))
    return sums.select(*groups, auc.alias("auc"))


def best_candidate(metrics: DataFrame, name: str = "candidate", metric: str = "auc") -> DataFrame:
    """The candidate with the highest metric; the first by name among equals."""
    ranked = metrics.filter(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), F.col(name)).limit(1)
    return ranked.select(name, metric)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, stat, value)``: count, mean, std, min, quartiles and max of numeric columns.

    Quartiles are exact; ``df.summary()`` has approximate ones. ``df`` is read several times, so it should be stored.
    """
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    flat = df.agg(*[f(F.col(f"`{c}`")).cast("double").alias(f"{s}_{c}") for s, f in measures.items() for c in columns])
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), F.col(f"`{s}_{c}`").alias("value"))
        for c in columns
        for s in measures
    ]
    quartiles = percentiles(df, columns, {"25%": 0.25, "50%": 0.5, "75%": 0.75})
    return (
        flat.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .unionByName(quartiles.unpivot("column", ["25%", "50%", "75%"], "stat", "value"))
    )
