import pytest
from pyspark.sql import functions as F

from rosterlab.operators import changes
from rosterlab.plans import durable
from rosterlab.plans.numbering import highest, number_rows
from rosterlab.session import sized_for, tune


def test_numbers_are_consecutive_in_order_and_stable(spark):
    df = spark.range(0, 5000, 1, 13).select(
        (F.col("id") * 7919 % 5003).alias("k"), F.col("id").alias("payload")
    )
    numbered = number_rows(df, ["k"], "n")
    got = [(r["k"], r["n"]) for r in numbered.collect()]
    assert sorted(n for _, n in got) == list(range(1, 5001))
    assert [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)
    assert sorted(got) == sorted((r["k"], r["n"]) for r in numbered.collect())


def test_one_key_with_a_third_of_the_rows_is_numbered_too(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("tie")
    )
    got = number_rows(df, ["k", "tie"], "n")
    assert got.where("k = 0").agg(F.max("n"), F.min("n")).first() == (1000, 1)


def test_empty_input(spark, make):
    assert number_rows(spark.range(0), ["id"], "n").count() == 0
    assert highest(make("unit", []), "unit_id") == 0


def test_ids_follow_the_highest_in_use(spark, world):
    batch = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "request_id long, t string")
    got = changes.assign_ids(batch, "request_id", world["unit"], "unit_id")
    assert {r["t"]: r["unit_id"] for r in got.collect()} == {"a": 10, "b": 11, "c": 12}


def test_first_load_splits_wide_rows(spark):
    staged = spark.createDataFrame(
        [(2, 8, "b", 60), (1, 9, "a", 50)], "line int, unit_id long, name string, pen int"
    )
    for column in ("nation_id", "category_id", "tier", "cost", "front", "side", "rear"):
        staged = staged.withColumn(column, F.lit(1))
    for column in ("media_path", "munition_name", "munition_kind"):
        staged = staged.withColumn(column, F.lit("x"))
    tables = changes.split_seed(staged.withColumn("rating", F.lit(2.0)), "line")
    got = tables["munition"].select("munition_id", "unit_id", "pen", "is_representative")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 9, 50, True), (2, 8, 60, True)]
    assert tables["unit"].count() == tables["spec"].count() == 2


def test_shuffle_settings_grow_with_the_data():
    small, large = sized_for(10, 8), sized_for(10 * 1024**4, 4000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert large["spark.sql.shuffle.partitions"] == str(20 * 1024)


def test_settings_of_the_caller_stay(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "123")
    try:
        assert tune(spark).conf.get(name) == "123"
        spark.conf.unset(name)
        assert tune(spark).conf.get(name) == "64MB"
    finally:
        spark.conf.set(name, before)


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.shared_folder(Session())
