"""Registered queries for sources / sinks (A) and the streaming apply."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabprobe.functions.columns import r4
from tabprobe.operators import models as M
from tabprobe.plans.registry import register
from tabprobe.session import ensure_checkpoint_dir
from tabprobe.sources import ingest as A
from tabprobe.sources.tables import fixture, fixture_cte, table
from tabprobe.streaming.apply_stream import apply_model_stream, file_stream


def _scratch(spark, what: str) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{what}-{uuid.uuid4().hex}"


@register("a1_read_table", fixture_cte("fx_nulls") + """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS VARCHAR) AS o_orderdate, round(o_totalprice, 4) AS o_totalprice,
       o_orderpriority FROM fx_nulls""")
def a1_read_table(spark, sf):
    """fx_nulls written as CSV (NULL → empty field), read back: NA tokens → NULL, types by try_cast counts."""
    path = _scratch(spark, "csv")
    fixture(spark, sf, "fx_nulls").write.option("header", True).csv(path)
    df, err = A.read_table(spark, path)
    if err:
        raise RuntimeError(err)
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("string").alias("o_orderdate"),
                     r4(F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority")


@register("a2_preview_columns")
def a2_preview_columns(spark, sf):
    path = _scratch(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return spark.createDataFrame([(i, x) for i, x in enumerate(A.preview_columns(spark, path))], "position int, column string")


TARGETS = [("orders", "o_orderstatus"), ("lineitem", "l_linenumber"), ("lineitem", "l_extendedprice"),
           ("customer", "c_nationkey"), ("labels", "quality")]


@register("a3_detect_problem_type", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS tbl, '{x}' AS target, CASE WHEN typeof(any_value({x})) = 'VARCHAR' OR count(DISTINCT {x}) < 10 "
    f"THEN 'classification' ELSE 'regression' END AS problem_type FROM {t}" for t, x in TARGETS))
def a3_detect_problem_type(spark, sf):
    rows = [(t, x, A.detect_problem_type(table(spark, sf, t), x)) for t, x in TARGETS]
    return spark.createDataFrame(rows, "tbl string, target string, problem_type string")


@register("a4_parse_datetimes", """
SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderstatus, o_orderpriority FROM orders""")
def a4_parse_datetimes(spark, sf):
    """orders with the date as text: the date column parses in full and becomes a timestamp; the others stay text."""
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderstatus",
        "o_orderpriority")
    out = A.parse_datetimes(df)
    assert dict(out.dtypes)["o_orderdate"].startswith("timestamp"), out.dtypes
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@register("a5_validate_target")
def a5_validate_target(spark, sf):
    df = table(spark, sf, "orders")
    rows = []
    for t in ("o_orderstatus", "no_such_column"):
        try:
            A.validate_target(df, t)
            rows.append((t, True, None))
        except ValueError as e:
            rows.append((t, False, str(e)))
    return spark.createDataFrame(rows, "target string, present boolean, message string")


@register("a7_write_predictions")
def a7_write_predictions(spark, sf):
    """Dummy-classifier predictions for the held-out orders, written as id + prediction CSV and read back."""
    df = M.split(table(spark, sf, "orders"), ["o_orderkey"])
    mode = M.dummy_classifier(df.where(~F.col("is_test")), "o_orderstatus")
    pred = df.where(F.col("is_test")).withColumn("prediction", F.lit(mode))
    path = A.write_predictions(pred, _scratch(spark, "pred"), key=["o_orderkey"])
    return spark.read.option("header", True).csv(path)


@register("s1_apply_model_stream")
def s1_apply_model_stream(spark, sf):
    """A FeatureModel fitted on fx_status training rows applied to orders arriving as a file stream
    (stream-static join to customer, then every fitted step)."""
    from tabprobe.plans.q_models import prepared
    _, model, _ = prepared(spark, sf, "fx_status", "o_orderstatus", "o_orderkey", "classification")
    orders = table(spark, sf, "orders")
    stream = file_stream(spark, sf, "orders.parquet", orders.schema)
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    joined = stream.join(cust, "o_custkey", "left").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_acctbal", "c_mktsegment")
    return apply_model_stream(spark, model, joined)
