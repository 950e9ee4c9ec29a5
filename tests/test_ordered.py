import random
import statistics

from pyspark.sql import functions as F

from transit_spark.operators.blocks import divider, keep_blocks, run_blocks
from transit_spark.operators.encode import frequency_index, hash_split, label_encode, median_impute, standardise
from transit_spark.operators.ordered import running_sum
from transit_spark.operators.percentiles import percentiles


def test_running_sum_with_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"g{i % 50}", i, rng.randint(-5, 5)) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g STRING, at INT, v BIGINT").repartition(7)
    totals, want = {}, {}
    for g, at, v in sorted(data, key=lambda r: r[1]):
        totals[g] = totals.get(g, 0) + v
        want[g, at] = totals[g]
    for largest in (10**6, 500, 10):
        summed = running_sum(df, ["at"], {"total": F.col("v")}, ["g"], group_rows=largest)
        assert {(r.g, r.at): r.total for r in summed.collect()} == want


def test_running_sum_of_everything_and_null_group(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 2 == 0, "a"))
    total = {r.id: r.n for r in running_sum(df, ["id"], {"n": F.lit(1)}).collect()}
    assert total == {i: i + 1 for i in range(1000)}
    by_group = {r.id: r.n for r in running_sum(df, ["id"], {"n": F.lit(1)}, ["g"], group_rows=10).collect()}
    assert by_group == {i: i // 2 + 1 for i in range(1000)}


def test_ranges_are_really_cut(spark):
    """The hot group spans several ranges, so no single window holds it."""
    df = spark.range(5000).withColumn("g", F.lit("hot"))
    plan = running_sum(df, ["id"], {"n": F.lit(1)}, ["g"], group_rows=1000)._jdf.queryExecution().toString()
    assert "__range" in plan and "CartesianProduct" not in plan


def test_percentiles_match_statistics(spark):
    rng = random.Random(2)
    xs = [rng.randint(0, 40) for _ in range(501)]
    ys = [rng.random() for _ in range(500)] + [None]
    df = spark.createDataFrame(list(zip(xs, ys)), "x INT, y DOUBLE")
    got = percentiles(df, ["x", "y"], {"q1": 0.25, "q2": 0.5, "q3": 0.75, "top": 1.0})
    got = {r["column"]: r for r in got.collect()}
    for name, data in (("x", xs), ("y", ys[:-1])):
        want = statistics.quantiles(data, n=4, method="inclusive")
        assert [round(got[name][q], 9) for q in ("q1", "q2", "q3")] == [round(w, 9) for w in want]
        assert got[name]["top"] == max(data)


def test_percentiles_of_any_doubles(spark):
    """Values of all sizes and signs, equal values, infinities, NaN; against the engine's own percentile."""
    rng = random.Random(4)
    columns = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "near": [1 + k * 2.0**-52 for k in range(400)],
        "hot": [7.0] * 390 + [float(k) for k in range(10)],
        "ends": [float("inf")] * 150 + [float("-inf")] * 150 + [0.0, -0.0] * 50,
        "tiny": [5e-324 * rng.randint(1, 9) for _ in range(400)],
        "below": [-(2.0 ** rng.randint(0, 60)) for _ in range(400)],
    }
    names = list(columns)
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} DOUBLE" for n in names)).repartition(5)
    points = {f"p{k}": k / 16 for k in range(17)}
    got = {r["column"]: list(r)[1:] for r in percentiles(df, names, points).collect()}
    for n in names:
        data = sorted(columns[n])
        for p, value in zip(points.values(), got[n]):
            place = (len(data) - 1) * p
            low, high = data[int(place)], data[-(-int(place * 10**6) // 10**6)] if place % 1 else data[int(place)]
            want = low if low == high else low + (high - low) * (place - int(place))
            assert str(value) == str(want + 0.0), (n, p)  # between -inf and 0 both are NaN
    nan = spark.sql("SELECT explode(array(double('NaN'), 1.0D, NULL, 2.0D)) AS x")
    assert percentiles(nan, ["x"], {"half": 0.5}).first().half == 2.0
    assert str(percentiles(nan, ["x"], {"top": 1.0}).first().top) == "nan"
    assert percentiles(nan.limit(0), ["x"], {"half": 0.5}).first().half is None


def test_percentiles_without_sort_or_window(spark):
    """A pass returns counts of parts; the rows themselves are neither sorted nor moved."""
    df = spark.range(100_000).selectExpr("cast(id % 997 as double) as x")
    got = percentiles(df, ["x"], {"half": 0.5})
    assert got.first().half == df.selectExpr("percentile(x, 0.5) as m").first().m
    plan = median_impute(df, ["x"])._jdf.queryExecution().toString()
    assert "Window" not in plan and "Sort" not in plan and "CartesianProduct" not in plan


def test_label_encode(spark, rows):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c"), (3, "a"), (4, None)], "i INT, s STRING")
    assert rows(label_encode(df, "s", "code"), "i", "code") == [(0, 1), (1, 0), (2, 2), (3, 0), (4, None)]


def test_frequency_index(spark, rows):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c"), (3, "c"), (4, None)], "i INT, s STRING")
    assert rows(frequency_index(df, "s", "code"), "i", "code") == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 3)]


def test_median_and_standardise(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (10, 5.0), (None, 5.0)], "x INT, k DOUBLE")
    assert sorted(r.x_imp for r in median_impute(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 10.0]
    scaled = [r.x_std for r in standardise(df, ["x"]).collect() if r.x_std is not None]
    assert abs(sum(scaled)) < 1e-12 and abs(statistics.stdev(scaled) - 1) < 1e-12
    assert {r.k_std for r in standardise(df, ["k"]).collect()} == {0.0}


def test_hash_split_is_a_partition(spark):
    df = spark.range(5000)
    train, test = hash_split(df, "id")
    assert train.count() + test.count() == 5000 and train.join(test, "id").count() == 0
    assert 0.77 < train.count() / 5000 < 0.83


def test_blocks(spark, rows):
    cards = ["s", "N/A", "s", "N/A", "s"]
    df = spark.createDataFrame(
        [(t, i, c, c) for t in ("t1", "t2") for i, c in enumerate(cards)], "train STRING, pos INT, station_name STRING, delay STRING"
    )
    blocks = run_blocks(df, "train", "pos", divider())
    assert rows(blocks.filter("train = 't2'"), "pos", "run_block") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]
    assert rows(keep_blocks(blocks), "train", "pos") == [("t1", 2), ("t1", 4), ("t2", 2), ("t2", 4)]
