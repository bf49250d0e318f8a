"""Test tables and the derived fixtures of FIXTURES.md.

Each fixture is one SQL text that runs unchanged on Spark and DuckDB, so the
Spark query and its oracle start from the same rows. Fixtures only shape the
input (select, join, inject NULLs); every operator's work happens in the
library code on top of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

FIXTURES = {
    "fx_nulls": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders""",
    "fx_shapes": """
SELECT event_id, 1 AS const_col, CAST(event_id % 2 AS INT) AS flag, CAST(event_id % 2 + 5 AS INT) AS two_valued,
       user_id, event_type, ts, value AS skewed, value - 40 AS skewed_neg
FROM events""",
    "fx_price": """
SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross_price,
       l_extendedprice * (1 - l_discount) AS net_price
FROM lineitem""",
    "fx_purchase": """
SELECT event_id, user_id, value, ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_purchase
FROM events""",
    "fx_signal": """
SELECT event_id, user_id, event_type, value, value * 2 + user_id AS mixed,
       CASE WHEN value > 50 THEN 1 ELSE 0 END AS big
FROM events""",
    "fx_status": """
SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority, c.c_acctbal, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "fx_quality": """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_dups": """
SELECT user_id, event_type FROM events""",
    "fx_brand": """
SELECT p_partkey, p_brand, p_type, p_name, p_size, p_retailprice FROM part""",
    "fx_predictions": """
SELECT o_orderkey, o_orderkey % 3 AS label, (o_orderkey * 7 + o_custkey) % 3 AS prediction,
       o_totalprice AS y, o_totalprice * 0.9 + o_custkey AS y_hat
FROM orders""",
    "fx_trials": """
SELECT * FROM (VALUES
  ('run1', 'ridge',  1, 0.61, 0.60, 'alpha', '0.5'),
  ('run1', 'ridge',  2, 0.66, 0.63, 'alpha', '2'),
  ('run1', 'tree',   1, 0.58, 0.59, 'max_depth', '6'),
  ('run2', 'tree',   1, 0.66, 0.64, 'max_depth', '8'),
  ('run2', 'forest', 1, 0.71, 0.70, 'max_features', 'sqrt')
) AS t(run_id, model_id, trial_index, cv_score, holdout_score, param_name, param_value)""",
}


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Temp views over the parquet tables (lazy: nothing is read until a query runs)."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _used_tables(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A FIXTURES.md fixture as a Spark DataFrame (the same SQL the oracle uses)."""
    sql = FIXTURES[name]
    register_tables(spark, sf_dir, _used_tables(sql))
    return spark.sql(sql)


def fixture_cte(*names: str) -> str:
    """``WITH`` clause defining the named fixtures, for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in names) + "\n"
