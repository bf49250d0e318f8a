"""Rows that are dear to make are made once: splits before the tests, predictions before the metrics, values before the ranks."""

from pyspark.sql import functions as F

from tabprobe.operators import models as M
from tabprobe.operators import ranks
from tabprobe.operators import stats as S


def counted(spark, df, col):
    """``df`` with ``col`` passed through a function, and the number of rows that went through it."""
    seen = spark.sparkContext.accumulator(0)

    def through(v):
        seen.add(1)
        return v
    return df.withColumn(col, F.udf(through, df.schema[col].dataType)(col)), seen


def test_metrics_predict_each_row_once(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), (None, "b"), ("c", None), ("b", "c")]
    df, seen = counted(spark, spark.createDataFrame(rows, "label string, prediction string"), "prediction")
    m = M.classification_metrics(df).first()
    assert seen.value == len(rows)
    # f1: a 2/3, b 2/5, c 0, no label 0
    assert abs(m["accuracy"] - 2 / 6) < 1e-12 and abs(m["f1_weighted"] - (2 * 2 / 3 + 2 * 2 / 5) / 6) < 1e-12


def test_spearman_makes_values_few_times(spark):
    n = 400
    base = spark.range(n).select((F.col("id") % 97).cast("double").alias("x"), (F.col("id") * 7 % 101).cast("double").alias("y"))
    df, seen = counted(spark, base, "x")
    got = S.spearman_test(df, ["x"], "y", rows_per_bucket=20, missing={"x": 0}).first()
    once = seen.value
    p = base.toPandas().rank()
    assert abs(got["rho"] - p["x"].corr(p["y"])) < 1e-9 and got["n"] == n
    assert once <= n


def test_few_ranks_are_broadcast(spark):
    rows = spark.range(3000).select((F.col("id") % 50).cast("double").alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = []
        out = ranks.attach_ranks(rows, "v", [], "r", held=held)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert [r["r"] for r in out.where("v = 1").distinct().collect()] == [60 + 61 / 2] and out.count() == 3000
        for vc in held:
            vc.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_fitting_rows_are_dealt_over_tasks(spark):
    one = spark.range(200_000).coalesce(1)
    out = M.spread(one, 200_000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 13 and max(sizes) < 20_000 and sum(sizes) == 200_000
    assert M.spread(one, 16_000) is one
