import types

import pytest
from pyspark.sql import functions as F

from transit_spark import session
from transit_spark.operators.joins import join_counted, with_global
from transit_spark.session import checkpoint_root, is_staged, stage


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_broadcast_only_within_the_bounds(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
        sums = facts.groupBy("k").agg(F.sum("id").alias("total"))
        small = join_counted(facts, sums, "k", max_rows=50)
        large = join_counted(facts, sums, "k", max_rows=49)
        assert "BroadcastHashJoin" in plan_of(small) and "SortMergeJoin" in plan_of(large)
        assert rows(small) == rows(large)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bytes_bound_and_empty_table(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from transit_spark.operators.joins import counted

        left, wide = spark.range(5), spark.range(5).withColumn("text", F.lit("x"))
        assert "SortMergeJoin" in plan_of(left.join(counted(wide, max_bytes=10), "id"))
        assert "BroadcastHashJoin" in plan_of(left.join(counted(wide), "id"))
        assert join_counted(left, wide.filter("id > 9"), "id").count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_global_row_as_constants(spark, rows):
    df = spark.range(3)
    got = with_global(df, df.agg(F.max("id").alias("top"), F.lit(None).cast("int").alias("none")), "all_")
    assert rows(got) == [(0, 2, None), (1, 2, None), (2, 2, None)]
    assert "Join" not in plan_of(got)


def test_staged_tables(spark):
    first = stage(spark.range(3).withColumn("a b", F.lit(1)))
    assert is_staged(first) and not is_staged(first.filter("id > 0")) and not is_staged(spark.range(3))
    root = checkpoint_root(spark)
    assert all(root in f for f in first.inputFiles())
    assert stage(first).columns == ["id", "a b"]


def test_checkpoint_folder_comes_from_the_session():
    def fake(master, **conf):
        return types.SimpleNamespace(
            conf=types.SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default)),
            sparkContext=types.SimpleNamespace(master=master, applicationId="app"),
        )

    assert session.checkpoint_root(fake("yarn", spark_checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        session.checkpoint_root(fake("yarn"))
    assert session.checkpoint_root(fake("local[2]")) == session.checkpoint_root(fake("local[2]"))
