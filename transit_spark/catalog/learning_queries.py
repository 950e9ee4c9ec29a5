"""Encoders, metrics and Spark ML."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from transit_spark.catalog import booking_queries as bq, delay_queries as dq, proxies as px
from transit_spark.catalog.registry import Registry
from transit_spark.catalog.request_queries import day_files
from transit_spark.models import candidates as cand, features
from transit_spark.models.delays import delay_training_set, evaluate_delay_model, stored_delay_model
from transit_spark.models.features import CATEGORICAL, NUMERIC
from transit_spark.models.store import ModelStore
from transit_spark.operators import encode, metrics
from transit_spark.operators.compare import actual_delays, prediction_vs_actual
from transit_spark.operators.joins import with_global
from transit_spark.operators.lookups import LOOKUP_MEANS, station_lookup
from transit_spark.operators.routes import global_stats, out_of_fold_stats, route_stats
from transit_spark.plans.bookings import request_inputs, score_bookings, training_set
from transit_spark.plans.delays import FEATURES, result_documents, score_delays, score_request_table
from transit_spark.session import stage

REGISTRY = Registry()
query = REGISTRY.query


@query(
    "label_encode",
    px.with_clause(px.FACTS)
    + """SELECT event_id, station, CAST(dense_rank() OVER (ORDER BY station) - 1 AS INTEGER) AS station_enc FROM facts""",
)
def label_encode(spark, sf_dir) -> DataFrame:
    return encode.label_encode(px.facts(spark, sf_dir).select("event_id", "station"), "station", "station_enc")


@query(
    "frequency_index",
    """SELECT p.p_partkey, p.p_brand, CAST(c.code AS INTEGER) AS brand_idx FROM part p JOIN (
  SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS code FROM part GROUP BY p_brand) c USING (p_brand)""",
)
def frequency_index(spark, sf_dir) -> DataFrame:
    part = px.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return encode.frequency_index(part, "p_brand", "brand_idx")


@query(
    "median_impute",
    px.with_clause(px.FACTS)
    + """SELECT event_id, delay_min, coalesce(CAST(delay_min AS DOUBLE),
       (SELECT quantile_cont(CAST(delay_min AS DOUBLE), 0.5) FROM facts)) AS delay_min_imp FROM facts""",
)
def median_impute(spark, sf_dir) -> DataFrame:
    return encode.median_impute(px.facts(spark, sf_dir).select("event_id", "delay_min"), ["delay_min"])


@query(
    "standardise",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - m.a) / m.s, 6) AS l_quantity_std,
       round((l_extendedprice - m.b) / m.t, 6) AS l_extendedprice_std
FROM lineitem, (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS s, avg(l_extendedprice) AS b,
                       stddev_samp(l_extendedprice) AS t FROM lineitem) m""",
)
def standardise(spark, sf_dir) -> DataFrame:
    lines = px.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scaled = encode.standardise(lines, ["l_quantity", "l_extendedprice"])
    return scaled.select(
        "l_orderkey",
        "l_linenumber",
        F.round("l_quantity_std", 6).alias("l_quantity_std"),
        F.round("l_extendedprice_std", 6).alias("l_extendedprice_std"),
    )


@query(
    "hash_split",
    """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 80
       THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def hash_split(spark, sf_dir) -> DataFrame:
    orders = px.table(spark, sf_dir, "orders").select("o_orderkey")
    part = F.when(encode.hash_bucket("o_orderkey") < 80, "train").otherwise("test")
    return orders.withColumn("part", part)


_FEATURES = ["delay_min", "rolling_72hr_avg_delay", "day_type", "is_maintenance_likely"]


def _describe_sql(column: str) -> str:
    v = f"CAST({column} AS DOUBLE)"
    stats = {
        "count": f"CAST(count({column}) AS DOUBLE)",
        "mean": f"avg({v})",
        "std": f"stddev_samp({v})",
        "min": f"min({v})",
        "25%": f"quantile_cont({v}, 0.25)",
        "50%": f"quantile_cont({v}, 0.5)",
        "75%": f"quantile_cont({v}, 0.75)",
        "max": f"max({v})",
    }
    return "\nUNION ALL ".join(
        f"""SELECT '{column}' AS "column", '{s}' AS stat, round({e}, 6) AS value FROM enriched""" for s, e in stats.items()
    )


@query(
    "describe_features",
    px.with_clause(px.FACTS, dq.ENRICHED) + "\nUNION ALL ".join(_describe_sql(c) for c in _FEATURES),
)
def describe_features(spark, sf_dir) -> DataFrame:
    rows = stage(dq.enriched(spark, sf_dir).select(*_FEATURES))
    return metrics.describe(rows, _FEATURES).withColumn("value", F.round("value", 6))


@query(
    "regression_metrics",
    px.with_clause(px.FACTS, dq.ENRICHED)
    + """SELECT count(*) AS n, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
       round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 6) AS r2
FROM (SELECT CAST(delay_min AS DOUBLE) AS y, rolling_72hr_avg_delay AS p, avg(delay_min) OVER () AS m
      FROM enriched WHERE delay_min IS NOT NULL)""",
)
def regression_metrics(spark, sf_dir) -> DataFrame:
    found = metrics.regression_metrics(dq.enriched(spark, sf_dir), "delay_min", "rolling_72hr_avg_delay")
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


_SCORED = px.with_clause(px.BOOKINGS, px.SILVER, px.GOLD) + (
    """, scored AS (SELECT s.label, g.route_confirmation_rate AS score,
  CASE WHEN g.route_confirmation_rate >= 0.5 THEN 1.0 ELSE 0.0 END AS predicted
FROM silver s JOIN gold g USING ("FromStation", "ToStation", "Class", "TrainType"))"""
)


def scored_bookings(spark, sf_dir) -> DataFrame:
    """Bookings with their route's confirmation rate as score."""
    enriched = bq.route_enrich(spark, sf_dir)
    return enriched.withColumn("predicted", F.when(F.col("route_confirmation_rate") >= 0.5, 1.0).otherwise(0.0))


@query(
    "classification_metrics",
    _SCORED
    + """, c AS (SELECT k.cls, count(*) FILTER (label = cls) AS real, count(*) FILTER (predicted = cls) AS guessed,
       count(*) FILTER (label = cls AND predicted = cls) AS hits FROM scored, (VALUES (0.0), (1.0)) k(cls) GROUP BY k.cls)
SELECT CAST(sum(real) AS BIGINT) AS n, round(sum(hits)::DOUBLE / sum(real), 9) AS accuracy,
       round(sum(real * 2.0::DOUBLE * hits / (real + guessed)) / sum(real), 9) AS f1 FROM c""",
)
def classification_metrics(spark, sf_dir) -> DataFrame:
    found = metrics.classification_metrics(scored_bookings(spark, sf_dir), "label", "predicted")
    return found.select("n", F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"))


_AUC_SQL = """SELECT {g}round((sum(CASE WHEN label = 1 THEN rk END) - p * (p + 1) / 2) / (p * q), 9) AS auc
FROM (SELECT *, sum(label) OVER ({w}) AS p, sum(1 - label) OVER ({w}) AS q,
             rank() OVER ({w} ORDER BY score) + (count(*) OVER ({w2} score) - 1) / 2.0::DOUBLE AS rk FROM {t})
GROUP BY {g}p, q"""


@query("auc_rank", _SCORED + _AUC_SQL.format(g="", w="", w2="PARTITION BY", t="scored"))
def auc_rank(spark, sf_dir) -> DataFrame:
    found = metrics.area_under_roc(scored_bookings(spark, sf_dir), "label", "route_confirmation_rate")
    return found.select(F.round("auc", 9).alias("auc"))


_CANDIDATES_SQL = """, candidates AS (
  SELECT 'distance' AS candidate, label, CAST("Distance" AS DOUBLE) AS score FROM silver
  UNION ALL SELECT 'fare', label, CAST("Fare" AS DOUBLE) FROM silver
  UNION ALL SELECT 'waitlist', label, CAST("WaitlistRank" AS DOUBLE) FROM silver WHERE "WaitlistRank" IS NOT NULL)
, aucs AS (""" + _AUC_SQL.format(
    g="candidate, ", w="PARTITION BY candidate", w2="PARTITION BY candidate,", t="candidates"
) + ")"


@query(
    "best_candidate",
    px.with_clause(px.BOOKINGS, px.SILVER) + _CANDIDATES_SQL + "\nSELECT * FROM aucs ORDER BY auc DESC, candidate LIMIT 1",
)
def best_candidate(spark, sf_dir) -> DataFrame:
    scores = {"distance": "Distance", "fare": "Fare", "waitlist": "WaitlistRank"}
    entries = [
        F.struct(F.lit(n).alias("candidate"), F.col(c).cast("double").alias("score")) for n, c in scores.items()
    ]
    long = bq.silver(spark, sf_dir).select("label", F.explode(F.array(*entries)).alias("e")).select("label", "e.*")
    aucs = metrics.area_under_roc(long, "label", "score", ["candidate"])
    return metrics.best_candidate(aucs).select("candidate", F.round("auc", 9).alias("auc"))


# --- features and folds of the booking models ---------------------------------------------------

_NUMBERS = ("Distance", "Fare", "WaitlistRank")


def _positions_sql() -> str:
    """Codes of every column by falling frequency, moved behind those of the columns before."""
    codes = [
        f"""c{k} AS (SELECT "{c}" AS v, row_number() OVER (ORDER BY count(*) DESC, "{c}") - 1 AS code
  FROM silver WHERE "{c}" IS NOT NULL GROUP BY "{c}")"""
        for k, c in enumerate(CATEGORICAL)
    ]
    begins = ["0", *[f"(SELECT count(*) FROM c{k})" for k in range(len(CATEGORICAL) - 1)]]
    spots = [f"c{k}.code + {' + '.join(begins[: k + 1])}" for k in range(len(CATEGORICAL))]
    joins = "\n".join(f"""LEFT JOIN c{k} ON c{k}.v = s."{c}" """ for k, c in enumerate(CATEGORICAL))
    return (
        ",\n".join(["", *codes])
        + f""",
hot AS (SELECT s."PNR", {', '.join(f's."{c}"' for c in _NUMBERS)}, concat_ws(',', {', '.join(spots)}) AS positions
  FROM silver s {joins})
"""
    )


def booking_categories(rows: DataFrame) -> list[features.Categories]:
    return [features.fit_categories(rows, c) for c in CATEGORICAL]


@query("one_hot", px.with_clause(px.BOOKINGS, px.SILVER) + _positions_sql() + 'SELECT "PNR", positions FROM hot')
def one_hot(spark, sf_dir) -> DataFrame:
    """Positions of the ones in every booking's vector, as text."""
    rows = stage(bq.silver(spark, sf_dir).select("PNR", *CATEGORICAL))
    found = features.one_hot_positions(rows, booking_categories(rows))
    return found.select("PNR", F.concat_ws(",", "positions").alias("positions"))


_SCALED_SQL = ", ".join(
    f"""round("{c}_imp" / (SELECT stddev_samp("{c}_imp") FROM imputed), 6) AS "{c}_scaled\"""" for c in _NUMBERS
)
_IMPUTED_SQL = ", ".join(
    f"""coalesce(CAST("{c}" AS DOUBLE), (SELECT quantile_cont(CAST("{c}" AS DOUBLE), 0.5) FROM hot)) AS "{c}_imp\""""
    for c in _NUMBERS
)


@query(
    "assembled_features",
    px.with_clause(px.BOOKINGS, px.SILVER)
    + _positions_sql()
    + f', imputed AS (SELECT "PNR", positions, {_IMPUTED_SQL} FROM hot)\nSELECT "PNR", positions, {_SCALED_SQL} FROM imputed',
)
def assembled_features(spark, sf_dir) -> DataFrame:
    """The assembled vector of every booking: positions of the ones, and three numbers imputed and scaled."""
    rows = stage(bq.silver(spark, sf_dir).select("PNR", *CATEGORICAL, *_NUMBERS))
    found = features.assembled(rows, booking_categories(rows), _NUMBERS)
    scaled = [F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in _NUMBERS]
    return found.select("PNR", F.concat_ws(",", "positions").alias("positions"), *scaled)


_FOLD_SQL = """('0x' || substr(md5("PNR"), 1, 8))::BIGINT % 100"""
_FOLDED = f""", folded AS (SELECT *, {_FOLD_SQL} AS bucket, CAST({_FOLD_SQL} % 3 AS INTEGER) AS fold FROM silver),
train AS (SELECT * FROM folded WHERE bucket < 80)
"""
_ROUTE = '"FromStation", "ToStation", "Class", "TrainType"'


@query(
    "out_of_fold_stats",
    px.with_clause(px.BOOKINGS, px.SILVER)
    + _FOLDED
    + f"""SELECT {_ROUTE}, f.fold, avg(label) AS route_confirmation_rate,
  CAST(sum("Fare") AS DOUBLE) / count("Fare") AS avg_fare_on_route,
  CAST(sum("Distance") AS DOUBLE) / count("Distance") AS avg_distance, count("PNR") AS bookings_count
FROM (SELECT DISTINCT {_ROUTE}, fold FROM train) f LEFT JOIN (SELECT {_ROUTE}, fold AS other, "PNR", label, "Fare", "Distance" FROM train) t
  USING ({_ROUTE}) WHERE t.other <> f.fold GROUP BY ALL
UNION ALL
SELECT {_ROUTE}, min(fold), NULL, NULL, NULL, 0 FROM train GROUP BY {_ROUTE} HAVING count(DISTINCT fold) = 1""",
)
def out_of_fold_stats_query(spark, sf_dir) -> DataFrame:
    """Route statistics of the training rows per fold, without the bookings of that fold."""
    bucket = encode.hash_bucket("PNR")
    train = bq.silver(spark, sf_dir).filter(bucket < 80).withColumn(encode.FOLD, (bucket % 3).cast("int"))
    return out_of_fold_stats(train, encode.FOLD)


# --- Spark ML: rows only, since results depend on how rows are partitioned -----------------------
# Every run has the stated sizes and grids. The booking models are fitted on all training rows. The delay forest is
# fitted on a bounded number of labelled rows; its statistics, codes of stations, scores and metrics cover all rows.

#: Most labelled rows that the delay forest is fitted on.
LABELLED_ROWS = 4_000


def delay_model(spark, sf_dir):
    """The forest of the surveyed size, its station codes, the training and the held-out rows."""
    rows, codes = delay_training_set(dq.full_facts(spark, sf_dir), keep=["event_id"])
    train, test = encode.hash_split(stage(rows), "event_id")
    train = stage(encode.bounded_rows(train, LABELLED_ROWS))
    model, codes = stored_delay_model(ModelStore(spark), train, codes, "event_id")
    return model, codes, train, test


@query("ml_delay_scores")
def ml_delay_scores(spark, sf_dir) -> DataFrame:
    model, _, _, test = delay_model(spark, sf_dir)
    return score_delays(test, model).select(
        "event_id", "train_number", "station", "travel_date", "delay_min", "predicted_delay_min", "delay_category"
    )


# Lookup with the three weather means, in hundredths, so that both engines add whole numbers.
_HUNDREDTHS = "CAST(floor({c} * 100 + 0.5) / 100 AS DECIMAL(18,2))"
_MODEL_LOOKUP = "model_lookup AS (\n  SELECT train_number, station, " + ", ".join(
    f"CAST(sum({_HUNDREDTHS.format(c=c)}) AS DOUBLE) / count({c}) AS {c}" for c in LOOKUP_MEANS
) + ", max(is_maintenance_likely) AS is_maintenance_likely\n  FROM filled GROUP BY train_number, station)"
_MODEL_CODES = """model_codes AS (
  SELECT station, CAST(row_number() OVER (ORDER BY station) - 1 AS INTEGER) AS station_enc
  FROM (SELECT DISTINCT station FROM facts WHERE delay_min IS NOT NULL))"""
_MODEL_SQL = px.with_clause(
    px.FACTS, dq.ENRICHED, *dq.WEATHER_CTES, dq.BACKFILLED.format(facts="enriched"), _MODEL_LOOKUP, _MODEL_CODES, px.DELAY_REQUESTS
)


def model_lookup(spark, sf_dir) -> DataFrame:
    """Averages per train and station over the whole fact table, weather included."""
    facts = dq.full_facts(spark, sf_dir)
    hundredths = {c: (F.floor(F.col(c) * 100 + 0.5) / 100).cast("decimal(18,2)") for c in LOOKUP_MEANS}
    return stage(station_lookup(facts.withColumns(hundredths)))


@query(
    "station_lookup_weather",
    _MODEL_SQL + f"SELECT train_number, station, {', '.join(LOOKUP_MEANS)}, is_maintenance_likely FROM model_lookup",
)
def station_lookup_weather(spark, sf_dir) -> DataFrame:
    return model_lookup(spark, sf_dir)


def model_scores(spark, sf_dir):
    """Requests scored by the fitted forest, error rows for the others, and the rows the forest was fitted on."""
    model, codes, train, _ = delay_model(spark, sf_dir)
    scored, errors = score_request_table(px.delay_requests(spark, sf_dir), model_lookup(spark, sf_dir), codes, model)
    return scored, errors, train


@query(
    "score_requests_model",
    _MODEL_SQL
    + f"""SELECT r.train_number, r.travel_date, l.station, c.station_enc, CAST(month(r.travel_date) AS INTEGER) AS month,
  CAST(day(r.travel_date) AS INTEGER) AS day, CAST(isodow(r.travel_date) - 1 AS INTEGER) AS day_of_week,
  CAST(weekofyear(r.travel_date) AS INTEGER) AS week, CASE WHEN dayofweek(r.travel_date) IN (0, 6) THEN 1 ELSE 0 END AS day_type,
  {', '.join(f'coalesce(l.{c}, 0) AS {c}' for c in LOOKUP_MEANS)}, l.is_maintenance_likely,
  true AS within_labels, true AS category_fits, NULL::VARCHAR AS error
FROM delay_requests r JOIN model_lookup l USING (train_number) JOIN model_codes c ON c.station = l.station
UNION ALL
SELECT train_number, travel_date, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  'Train ' || train_number || ' not found. Please check the train number and try again.'
FROM delay_requests WHERE train_number NOT IN (SELECT train_number FROM model_lookup)""",
)
def score_requests_model(spark, sf_dir) -> DataFrame:
    """The feature grid of every request and stop, scored by the fitted forest, and the error rows.

    A forest averages labels, so a prediction lies within them; its category is that of the rounded prediction.
    """
    scored, errors, train = model_scores(spark, sf_dir)
    ends = train.agg(F.min("delay_min").alias("least"), F.max("delay_min").alias("most"))
    minutes, name = F.col("predicted_delay_min"), F.col("delay_category")
    fits = (
        ((minutes <= 15) & (name == "On Time"))
        | ((minutes > 15) & (minutes <= 60) & (name == "Slight Delay"))
        | ((minutes > 60) & (name == "Significant Delay"))
    )
    rows = with_global(scored, ends).select(
        "train_number",
        "travel_date",
        "station",
        *[f for f in FEATURES if f != "train_number"],
        F.col("prediction").between(F.col("least") - 1e-6, F.col("most") + 1e-6).alias("within_labels"),
        fits.alias("category_fits"),
    )
    return rows.unionByName(errors, allowMissingColumns=True)


@query("ml_request_documents")
def ml_request_documents(spark, sf_dir) -> DataFrame:
    """One JSON document per request: the stops as the forest scores them, or the error."""
    scored, errors, _ = model_scores(spark, sf_dir)
    return result_documents(scored, errors)


@query("ml_prediction_vs_actual")
def ml_prediction_vs_actual(spark, sf_dir) -> DataFrame:
    """What the forest predicts for a train and station, averaged over the requested dates, beside what was scraped."""
    scored, _, _ = model_scores(spark, sf_dir)
    predictions = scored.groupBy("train_number", "station").agg(F.bround(F.avg("prediction"), 1).alias("predicted_delay_min"))
    return prediction_vs_actual(predictions, actual_delays(*day_files(spark, sf_dir)))


@query("ml_delay_metrics")
def ml_delay_metrics(spark, sf_dir) -> DataFrame:
    model, _, _, test = delay_model(spark, sf_dir)
    return evaluate_delay_model(model, test)


_BUCKET = "__bucket"


def booking_rows(spark, sf_dir) -> DataFrame:
    """The silver columns the models use and the hash bucket of each booking, written once."""
    silver = bq.silver(spark, sf_dir).select(
        "PNR", *CATEGORICAL, "Distance", "Fare", "Passengers", *bq._FLAGS, "FinalStatus"
    )
    return stage(silver.withColumn(_BUCKET, encode.hash_bucket("PNR")))


def _split(rows: DataFrame):
    """All training and test rows; the route statistics leave out the labels of a row's own fold."""
    train, test = training_set(rows, fit_on="out_of_fold", bucket=_BUCKET)
    return stage(train), stage(test)


_MODEL_COLUMNS = ("PNR", *CATEGORICAL, *NUMERIC, "label")


def confirmation_run(spark, rows: DataFrame):
    """The run of the three candidates with their full grids, fitted once per table and stored."""
    train, test = _split(rows)
    store = ModelStore(spark)

    def fit(missing):
        return cand.fit_candidates(train, test, missing, parallelism=8)

    return store, cand.stored_run(store, train, test, cand.confirmation_candidates(), fit, _MODEL_COLUMNS), test


@query("ml_candidate_metrics")
def ml_candidate_metrics(spark, sf_dir) -> DataFrame:
    """Metrics and chosen parameters of the three candidates, as stored in the log."""
    store, run, _ = confirmation_run(spark, booking_rows(spark, sf_dir))
    return store.log().filter((F.col("run") == run) & (F.col("kind") != "model"))


@query("ml_best_candidate")
def ml_best_candidate(spark, sf_dir) -> DataFrame:
    """The fitted candidates by logged area under the ROC curve, the best first."""
    store, run, _ = confirmation_run(spark, booking_rows(spark, sf_dir))
    return store.ranking(run)


@query("ml_inference_results")
def ml_inference_results(spark, sf_dir) -> DataFrame:
    """Test rows scored by the best candidate of the log."""
    store, run, test = confirmation_run(spark, booking_rows(spark, sf_dir))
    return cand.infer_confirmations(store.best(run)[1], test)


@query("confirmation_scores")
def confirmation_scores(spark, sf_dir) -> DataFrame:
    """Requests scored by the best candidate of the log."""
    rows = booking_rows(spark, sf_dir)
    store, run, _ = confirmation_run(spark, rows)
    requests = px.booking_requests(spark, sf_dir)
    inputs = request_inputs(requests, route_stats(rows), global_stats(rows))
    return score_bookings(inputs, store.best(run)[1], requests.columns)


def fare_model(spark, sf_dir):
    train, test = _split(booking_rows(spark, sf_dir))
    store, forest = ModelStore(spark), cand.fare_candidate()

    def fit(missing):
        return [cand.fit_fare(train, test, missing[0], parallelism=8)]

    run = cand.stored_run(store, train, test, [forest], fit, _MODEL_COLUMNS)
    return store.load(run, forest.name), test


@query("ml_fare_scores")
def ml_fare_scores(spark, sf_dir) -> DataFrame:
    scoring, test = fare_model(spark, sf_dir)
    return cand.infer_fares(scoring, test)


@query("ml_feature_importance")
def ml_feature_importance(spark, sf_dir) -> DataFrame:
    scoring, _ = fare_model(spark, sf_dir)
    return cand.feature_importance(scoring, spark)
