"""Driver contract: entry runs; every oracle has a query; a subset matches DuckDB at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tabprobe.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SUBSET = ["b1_semantic_types", "b4_numeric_summary", "b11_top_values", "c3_duplicate_rows", "c8_fe_recommendations",
          "d3_histogram", "d9_target_by_top_categories", "e7_anova_oneway", "e12_chi_square", "e21_mutual_information",
          "f17_target_encode", "g9_classification_metrics", "h2_cv_folds", "a4_parse_datetimes"]


def _canon(cols, rows):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(norm(r[i])) for i in order) for r in rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == len(spark.read.parquet(f"{SF}/lineitem.parquet").columns)
    assert {"column", "semantic_type", "mean", "top_value"} <= set(df.columns)


def test_registry_names():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    # corpus operators are numbered op1 to op10; they may be absent, the rest may not
    assert sum(not k.startswith("op") and k != "pipeline" for k in q) >= 123


@pytest.mark.parametrize("name", SUBSET)
def test_oracle_subset(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert _canon(df.columns, df.collect()) == _canon(res.columns, res.fetchall())
