import datetime as dt
import random

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from transit_spark import schemas
from transit_spark.catalog import learning_queries as lq
from transit_spark.models import candidates as cand
from transit_spark.models.delays import delay_training_set, evaluate_delay_model, fit_delay_model
from transit_spark.models.features import (
    add_codes,
    assembled,
    fit_categories,
    fit_features,
    hashed_code,
    one_hot_positions,
    score_features,
)
from transit_spark.models.store import METRIC_LOG, LOG_KEY, ModelStore, ScoringModel, run_name
from transit_spark.operators.encode import bounded_rows, hash_bucket, hash_split
from transit_spark.operators.metrics import area_under_roc
from transit_spark.operators.routes import global_stats, out_of_fold_stats, route_stats
from transit_spark.plans.bookings import request_inputs, score_bookings, silver_from_path, training_set
from transit_spark.plans.delays import FEATURES, result_documents, score_delays, score_request_table
from transit_spark.session import stage
from transit_spark.sinks.tables import append_new, read_appended


@pytest.fixture(scope="module")
def silver(spark):
    """Bookings whose outcome follows the waitlist and whose fare follows the distance."""
    rng = random.Random(5)
    data = []
    for i in range(1500):
        waiting = rng.choice([0, 3, 40, 90])
        confirmed = rng.random() < (0.95 if waiting < 10 else 0.1)
        distance = rng.randint(50, 2000)
        data.append((
            str(i), 1, "01-Sep", rng.choice(["SL", "2AC"]), "GN", f"F{i % 4}", f"T{i % 3}", "01-Jan",
            "Confirmed" if waiting == 0 else "WL", 1 + i % 4, "Adult", "Online", distance, 10, 18, "Express",
            distance * 2 + rng.randint(0, 50), "None" if i % 2 else None, "No", f"WL{waiting}" if waiting else "null",
            "Confirmed" if confirmed else "Not Confirmed",
        ))
    return stage(silver_from_path(spark.createDataFrame(data, schemas.BOOKINGS)))


@pytest.fixture(scope="module")
def fitted(silver):
    train, test = (stage(p) for p in training_set(silver, fit_on="train"))
    return cand.fit_candidates(train, test, cand.confirmation_candidates(full=False), folds=2), test


def test_candidates_learn(spark, fitted, rows):
    models, _ = fitted
    assert [m.name for m in models] == ["RandomForest", "GBT", "LogisticRegression"]
    assert all(m.metrics["auc_roc"] > 0.85 and m.metrics["accuracy"] > 0.8 for m in models)
    log = cand.metric_log(spark, "r1", models)
    assert log.filter("kind = 'metric'").count() == 9
    assert log.filter("candidate = 'RandomForest' AND name = 'maxDepth'").count() == 1
    assert cand.best_fitted(models).metrics["auc_roc"] == max(m.metrics["auc_roc"] for m in models)


def test_inference_and_reload(spark, fitted, tmp_path, rows):
    models, test = fitted
    logistic = models[2]
    results = cand.infer_confirmations(logistic.pipeline, test)
    assert results.columns == ["PNR", "FinalStatus", "label", "prediction", "probability"]
    assert results.count() == test.count() and all(abs(sum(r.probability) - 1) < 1e-9 for r in results.collect())
    logistic.pipeline.save(str(tmp_path / "model"))
    loaded = ScoringModel.load(spark.newSession(), str(tmp_path / "model"))
    again = loaded.transform(test)
    assert rows(again, "PNR", "prediction") == rows(results, "PNR", "prediction")


def test_confirmation_requests(spark, silver, fitted, rows):
    requests = spark.createDataFrame(
        [(1, "Confirmed", 0, "SL", "F0", "T0", "15-Jun"), (2, "WL", 90, "SL", "F0", "T0", "15-Jun"), (3, "WL", 90, "9AC", "?", "?", "15-Jun")],
        schemas.BOOKING_REQUESTS,
    )
    scores = score_bookings(request_inputs(requests, route_stats(silver), global_stats(silver)), fitted[0][2].pipeline)
    by_train = {r.train_no: r for r in scores.collect()}
    assert by_train[1].predicted_status == "Confirmed" and by_train[2].predicted_status == "Not Confirmed"
    assert abs(by_train[1].confirmed_probability + by_train[1].not_confirmed_probability - 1) < 2e-4
    assert by_train[2].is_waitlisted and not by_train[1].is_waitlisted
    assert by_train[3].confidence in ("High", "Medium", "Low")


def test_fare_model(silver, rows):
    train, test = (stage(p) for p in training_set(silver))
    fitted = cand.fit_fare(train, test, cand.fare_candidate(full=False), folds=2)
    assert fitted.metrics["r2"] > 0.7 and set(fitted.metrics) == {"rmse", "mae", "r2"}
    importance = cand.feature_importance(fitted).collect()
    assert importance[0].feature == "Distance_imp" and abs(sum(r.importance for r in importance) - 1) < 1e-6
    fares = cand.infer_fares(fitted.pipeline, test)
    assert fares.columns == ["PNR", "Fare", "predicted_fare"] and fares.count() == test.count()


def test_centering_changes_no_prediction(silver):
    train, test = (stage(p) for p in training_set(silver))
    logistic = cand.confirmation_candidates()[2]
    plain, centred = (
        cand.fit_candidates(train, test, [logistic], folds=2, center=c)[0] for c in (False, True)
    )
    p = {r.PNR: r.probability[1] for r in cand.infer_confirmations(plain.pipeline, test).collect()}
    q = {r.PNR: r.probability[1] for r in cand.infer_confirmations(centred.pipeline, test).collect()}
    assert plain.model.getRegParam() == centred.model.getRegParam()
    assert max(abs(p[k] - q[k]) for k in p) < 1e-6


def test_forest_scores_dense_vectors_alike(spark):
    rows = spark.range(300).select(
        (F.col("id") % 2).cast("double").alias("label"), F.array(F.col("id") % 7 * 1.0, F.lit(0.0), F.col("id") % 3 * 1.0).alias("a")
    )
    data = stage(rows.select("label", array_to_vector("a").alias("features")))
    model = RandomForestClassifier(numTrees=5, seed=1).fit(data)
    columns = ("label", "prediction", "rawPrediction", "probability")
    scored, plain = score_features(model, data), model.transform(data)
    assert scored.columns == plain.columns
    assert scored.select(*columns).exceptAll(plain.select(*columns)).count() == 0
    assert scored.count() == 300
    metrics = cand._classification_metrics(model, data)
    assert metrics["accuracy"] == MulticlassClassificationEvaluator(metricName="accuracy").evaluate(plain)
    assert metrics["f1_score"] == MulticlassClassificationEvaluator(metricName="f1").evaluate(plain)
    assert metrics["auc_roc"] == pytest.approx(BinaryClassificationEvaluator().evaluate(plain), abs=1e-12)


def test_split_by_a_stored_bucket(silver):
    """Each pass reads the bucket; none computes it from the key again."""
    with_bucket = stage(silver.withColumn("b", hash_bucket("PNR")))
    for got, want in zip(
        training_set(with_bucket, fit_on="out_of_fold", bucket="b"), training_set(silver, fit_on="out_of_fold"), strict=True
    ):
        assert got.columns == want.columns
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
        assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()


class Reached(Exception):
    pass


@pytest.fixture(scope="module")
def many_bookings(spark):
    """7,000 bookings as the booking models read them."""
    rows = spark.range(7000).selectExpr(
        "cast(id as string) as PNR", "concat('F', id % 5) as FromStation", "concat('T', id % 3) as ToStation", "'SL' as Class",
        "'X' as TrainType", "'GN' as Quota", "'WL' as BookingStatus", "'Adult' as PassengerType", "'Online' as BookingChannel",
        "'None' as Concession", "cast(id % 90 as int) as Distance", "cast(id % 70 as int) as Fare", "1 as Passengers", "1 as IsWaitlisted",
        "cast(id % 11 as int) as WaitlistRank", "0 as IsHoliday", "0 as HasConcession", "0 as IsConfirmed_AtBooking",
        "cast(id % 2 as double) as label", "if(id % 2 = 1, 'Confirmed', 'Not Confirmed') as FinalStatus",
    )
    return stage(rows.withColumn(lq._BUCKET, hash_bucket("PNR")))


@pytest.mark.parametrize("name", ["ml_best_candidate", "confirmation_scores", "ml_inference_results", "ml_feature_importance"])
def test_booking_models_are_fitted_on_all_training_rows(spark, many_bookings, monkeypatch, name):
    def fit(train, test, *_, **__):
        raise Reached(sorted(r.PNR for r in train.select("PNR").collect()), test.count())

    monkeypatch.setattr(lq, "booking_rows", lambda spark, sf_dir: many_bookings)
    monkeypatch.setattr(lq.cand, "fit_candidates", fit)
    monkeypatch.setattr(lq.cand, "fit_fare", fit)
    with pytest.raises(Reached) as reached:
        lq.REGISTRY.queries[name](spark, "no folder")
    want = sorted(r.PNR for r in many_bookings.filter(F.col(lq._BUCKET) < 80).select("PNR").collect())
    assert len(want) > lq.LABELLED_ROWS and reached.value.args == (want, 7000 - len(want))


def test_few_fits_at_once_on_many_partitions(spark):
    assert [cand._side_by_side(spark.range(100, numPartitions=n), 8) for n in (1, 2, 5, 8, 40)] == [8, 4, 2, 1, 1]


def test_full_grids_have_the_stated_sizes():
    assert [len(c.grid) for c in cand.confirmation_candidates()] == [4, 4, 2]
    assert len(cand.fare_candidate().grid) == 8


def test_codes_and_positions(spark, rows):
    df = spark.createDataFrame([("b", "x"), ("b", None), ("a", "y"), ("c", "x"), (None, "x")], "p STRING, q STRING")
    found = [fit_categories(df, c) for c in ("p", "q")]
    assert rows(found[0].table) == [("a", 1), ("b", 0), ("c", 2)] and [c.size for c in found] == [3, 2]
    unseen = df.union(spark.createDataFrame([("new", "y")], df.schema))
    assert rows(one_hot_positions(unseen, found), "p", "positions") == rows(
        spark.createDataFrame([("b", [0, 3]), ("b", [0]), ("a", [1, 4]), ("c", [2, 3]), (None, [3]), ("new", [4])], "p STRING, positions ARRAY<INT>")
    )
    assert rows(add_codes(unseen, found), "p", "p_idx")[-1] == (None, 3)
    hashed = fit_categories(df, "p", width=7)
    assert hashed.table is None and {r.p_idx for r in add_codes(df, [hashed]).collect()} <= set(range(8))
    assert rows(add_codes(df, [hashed]).where("p = 'a'"), "p_idx") == rows(spark.range(1).select(hashed_code(F.lit("a"), 7)))
    nothing = fit_categories(df.where("p is null"), "p")
    assert nothing.size == 1 and nothing.table.count() == 0


def test_vectors_equal_the_plain_columns(spark, silver):
    """The vectors that models see hold the positions and numbers of the relational form."""
    train = silver.withColumns({c: F.col(c).cast("double") for c in ("Distance", "WaitlistRank")})
    names, numbers = ("Class", "FromStation", "Concession"), ("Distance", "WaitlistRank")
    fitted = fit_features(train, names, numbers)
    plain = assembled(train, fitted.categories, numbers)
    width = sum(c.size for c in fitted.categories)
    for r in fitted.transform(plain).select("positions", "raw_features", "features", "Distance_scaled").collect():
        raw = r.raw_features
        assert raw.size == width + 2 and sorted(r.positions) == [i for i in range(width) if raw[i]]
        assert r.features[width] == pytest.approx(r.Distance_scaled)


def test_unseen_category_is_kept(spark, silver):
    train = training_set(silver)[0]
    fitted = fit_features(train)
    known = fitted.transform(train).select("features").first().features.size
    odd = fitted.transform(train.withColumn("Class", F.lit("new")).withColumn("Quota", F.lit(None).cast("string")))
    assert odd.select("features").first().features.size == known and odd.count() == train.count()


def test_two_hundred_thousand_categories(spark):
    """The outcome follows the first letter of a name that every row has for itself, and one shared column."""
    rows = spark.range(200_000).selectExpr(
        "concat('n', id) as name", "if(id % 3 = 0, 'yes', 'no') as hint", "cast(id % 7 as double) as size",
        "if(id % 3 = 0, 1.0D, 0.0D) as label", "cast(id as string) as PNR",
    )
    train, test = (stage(p) for p in hash_split(rows, "PNR"))
    logistic = cand.Candidate("LogisticRegression", cand.LogisticRegression(maxIter=5, regParam=0.01), [{}])
    fitted = cand.fit_candidates(train, test, [logistic], ["name", "hint"], ["size"])[0]
    assert fitted.features.categories[0].size == train.count() > 150_000
    assert fitted.model.numFeatures == fitted.features.categories[0].size + 3 and fitted.metrics["auc_roc"] > 0.99
    narrow = cand.fit_candidates(train, test, [logistic], ["name", "hint"], ["size"], widths={"name": 512})[0]
    assert narrow.model.numFeatures == 515 and narrow.metrics["auc_roc"] > 0.99


@pytest.fixture(scope="module")
def noise(spark):
    """Bookings of very many routes whose label is a coin toss."""
    rows = spark.range(3000).selectExpr(
        "cast(id as string) as PNR", "concat('F', id % 37) as FromStation", "concat('T', id % 29) as ToStation", "'SL' as Class",
        "'X' as TrainType", "100 as Distance", "cast(200 as int) as Fare", "cast(conv(substr(md5(concat('s', id)), 1, 4), 16, 10) % 2 as double) as label",
    )
    return stage(rows)


def test_statistics_leave_out_the_own_fold(spark, noise, rows):
    train, test = (stage(p) for p in training_set(noise, fit_on="out_of_fold"))
    assert {r.fold for r in train.select("fold").distinct().collect()} == {0, 1, 2}
    plain = {}
    for r in train.collect():
        plain.setdefault((r.FromStation, r.ToStation), []).append((r.fold, r.label))
    for r in train.collect():
        others = [y for f, y in plain[r.FromStation, r.ToStation] if f != r.fold]
        assert r.bookings_count == len(others)
        assert r.route_confirmation_rate == (pytest.approx(sum(others) / len(others)) if others else None)
    for r in test.collect():
        own = [y for _, y in plain.get((r.FromStation, r.ToStation), [])]
        assert r.route_confirmation_rate == (pytest.approx(sum(own) / len(own)) if own else None)


def test_random_labels_cannot_be_learned(spark, noise):
    """Statistics over all training rows show a row its own label; those of the other folds do not."""
    def area(fit_on):
        train = training_set(noise, fit_on=fit_on)[0]
        return area_under_roc(train, "label", "route_confirmation_rate").first().auc

    assert area("train") > 0.8 and abs(area("out_of_fold") - 0.5) < 0.06


def test_empty_and_missing_folds(spark, noise):
    assert out_of_fold_stats(noise.withColumn("fold", F.lit(1)).limit(0), "fold").count() == 0
    once = noise.limit(1).withColumn("fold", F.lit(2)).withColumn("Fare", F.lit(None).cast("int"))
    assert [tuple(r)[5:] for r in out_of_fold_stats(once, "fold").collect()] == [(None, None, None, 0)]


def small_candidates():
    forest = cand.RandomForestClassifier(numTrees=10, maxDepth=4, seed=1)
    return [
        cand.Candidate("RandomForest", forest, [{}]),
        cand.Candidate("LogisticRegression", cand.LogisticRegression(maxIter=10), [{}]),
    ]


def test_best_of_the_log_goes_on(spark, tmp_path):
    """The label is whether two numbers have the same sign, which no linear model sees."""
    rng = random.Random(3)
    data = [(str(i), rng.choice("ab"), rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(1500)]
    rows = spark.createDataFrame(data, "PNR STRING, kind STRING, x DOUBLE, y DOUBLE").selectExpr(
        "*", "if(x * y > 0, 1.0D, 0.0D) as label", "if(x * y > 0, 'Confirmed', 'Not') as FinalStatus"
    )
    train, test = (stage(p) for p in hash_split(rows, "PNR"))
    fits = []

    def fit(missing):
        fits.append([c.name for c in missing])
        return cand.fit_candidates(train, test, missing, ["kind"], ["x", "y"])

    store, columns = ModelStore(spark, str(tmp_path)), ("PNR", "kind", "x", "y", "label")
    run = cand.stored_run(store, train, test, small_candidates(), fit, columns)
    log = sorted(map(tuple, store.log().collect()))
    assert store.candidates(run) == ["LogisticRegression", "RandomForest"]

    other = ModelStore(spark.newSession(), str(tmp_path))  # another session reads the log and loads what it names
    shuffled = train.repartition(7)
    assert cand.stored_run(other, shuffled, test, small_candidates(), fit, columns) == run
    assert fits == [["RandomForest", "LogisticRegression"]] and sorted(map(tuple, other.log().collect())) == log
    name, model = other.best(run)
    assert name == "RandomForest" and [r.candidate for r in other.ranking(run).collect()] == ["RandomForest", "LogisticRegression"]
    scored = cand.infer_confirmations(model, test)
    assert area_under_roc(scored.withColumn("p", F.col("probability")[1]), "label", "p").first().auc > 0.9

    deeper = small_candidates()[:1]
    deeper[0].estimator.setMaxDepth(5)
    assert cand.stored_run(store, train, test, deeper, fit, columns) != run and len(fits) == 2
    assert run_name(train, columns) != run_name(test, columns)
    with pytest.raises(LookupError):
        store.best("no such run")
    with pytest.raises(LookupError):
        store.load(run, "Nobody")


def test_log_survives_reruns(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_appended(spark, path, METRIC_LOG, LOG_KEY).count() == 0
    rows = spark.createDataFrame([("r", "c", "metric", "auc", "1"), ("r", "c", "metric", "auc", "2"), ("r", "c", "metric", None, "3")], METRIC_LOG)
    for _ in range(2):
        append_new(rows, path, LOG_KEY)
    assert spark.read.parquet(path).count() == 2 == read_appended(spark, path, METRIC_LOG, LOG_KEY).count()
    append_new(rows.withColumn("run", F.lit("s")), path, LOG_KEY)
    assert spark.read.parquet(path).count() == 4
    rows.limit(1).write.mode("append").parquet(path)  # as if another writer had come at the same time
    assert read_appended(spark, path, METRIC_LOG, LOG_KEY).count() == 4


def test_bounded_rows_are_the_same_ones(spark, noise):
    few = {r.PNR for r in bounded_rows(noise, 50).collect()}
    assert len(few) == 50 and few == {r.PNR for r in bounded_rows(noise.repartition(9), 50).collect()}


def test_requests_by_the_model(spark, rows):
    """Stops scored from the lookup's features; unknown trains and stations without a code become errors."""
    names = ", ".join(f"{f} DOUBLE" for f in FEATURES) + ", delay_min DOUBLE"
    rng = random.Random(2)
    data = [[float(rng.choice([1, 2])), float(rng.choice([0, 1])), *[0.0] * 9, float(rng.choice([0, 3]))] for _ in range(400)]
    train = spark.createDataFrame([(*r, 20.0 * r[1] + 10 * r[11]) for r in data], names)
    model = fit_delay_model(train, numTrees=10)
    means = "train_number INT, station STRING, rolling_72hr_avg_delay DOUBLE, weather_code DOUBLE, precipitation_mm DOUBLE, weather_risk_score DOUBLE, is_maintenance_likely INT"
    lookup = spark.createDataFrame(
        [(1, "A", 9.0, 0.0, 0.0, 3.0, 0), (1, "B", 9.0, 0.0, 0.0, 0.0, 0), (2, "A", None, None, None, None, None), (3, "A", 1.0, 0.0, 0.0, 0.0, 0), (3, "Q", 1.0, 0.0, 0.0, 0.0, 0)],
        means,
    )
    codes = spark.createDataFrame([("A", 0), ("B", 1)], "station STRING, station_enc INT")
    day = dt.date(2025, 12, 25)
    requests = spark.createDataFrame([(1, day), (1, day), (2, day), (3, day), (9, day)], schemas.DELAY_REQUESTS)
    scored, errors = score_request_table(requests, lookup, codes, model)
    got = {(r.train_number, r.station): r for r in scored.collect()}
    assert set(got) == {(1, "A"), (1, "B"), (2, "A")} and scored.count() == 3
    assert got[1, "A"].predicted_delay_min == pytest.approx(30, abs=3) and got[1, "A"].delay_category == "Slight Delay"
    assert got[1, "B"].predicted_delay_min == pytest.approx(20, abs=3) and got[1, "B"].station_enc == 1
    assert got[2, "A"].weather_risk_score == 0.0 and got[2, "A"].day_type == 2 and got[2, "A"].predicted_delay_min < 3
    assert rows(errors, "train_number", "error") == [
        (3, "Station encoding failed for train 3."),
        (9, "Train 9 not found. Please check the train number and try again."),
    ]
    documents = {r.train_number: r.document for r in result_documents(scored, errors).collect()}
    assert len(documents) == 4 and '"stops":[],"error":"Station encoding failed' in documents[3] and '"error":null' in documents[1]


def test_delay_model(spark, tmp_path):
    rng = random.Random(6)
    data = []
    for i in range(1500):
        station = rng.choice("ABC")
        data.append((
            i, 10 + i % 3, station, dt.date(2025, 1, 1) + dt.timedelta(days=i % 60),
            None if i % 50 == 0 else {"A": 5, "B": 40, "C": 90}[station] + rng.randint(0, 5),
            0, 10.0, 0, 1.0, 0.5, 1.0,
        ))
    facts = spark.createDataFrame(
        data,
        "i INT, train_number INT, station STRING, travel_date DATE, delay_min INT, day_type INT, rolling_72hr_avg_delay DOUBLE, "
        "is_maintenance_likely INT, weather_code DOUBLE, precipitation_mm DOUBLE, weather_risk_score DOUBLE",
    )
    rows, codes = delay_training_set(facts, keep=["i"])
    assert {(r.station, r.station_enc) for r in codes.collect()} == {("A", 0), ("B", 1), ("C", 2)}
    train, test = hash_split(stage(rows), "i")
    model = fit_delay_model(train, numTrees=10)
    assert evaluate_delay_model(model, test).first().r2 > 0.9
    scored = score_delays(test, model)
    cand.save_pipeline(model, str(tmp_path / "delay"))
    again = score_delays(test, cand.load_pipeline(str(tmp_path / "delay")))
    assert scored.select("i", "predicted_delay_min").exceptAll(again.select("i", "predicted_delay_min")).count() == 0
    assert {r.delay_category for r in scored.filter("station = 'C'").select("delay_category").distinct().collect()} == {"Significant Delay"}
