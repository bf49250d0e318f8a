"""Quantiles, ranks and the numeric profile against pandas on frames with ties, NULLs and NaN."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import profile as P
from tabprobe.operators import ranks
from tabprobe.operators.longform import numeric_long


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "a": rng.integers(0, 40, n).astype(float),          # many ties
        "b": rng.exponential(3.0, n),                        # skewed
        "c d": rng.normal(10, 2, n),                         # space in the name
    })
    pdf.loc[::17, "b"] = np.nan                              # NaN must count as missing
    sdf = spark.createDataFrame(pdf)
    return pdf, sdf


@pytest.mark.parametrize("rpb", [2_000_000, 50, 7])
def test_quantiles_match_pandas(frame, rpb):
    pdf, sdf = frame
    lg = numeric_long(sdf, list(pdf.columns))
    got = ranks.quantiles_wide(lg, {"q1": .25, "med": .5, "q3": .75, "p9": .9}, rows_per_bucket=rpb).collect()
    got = {r["column"]: r for r in got}
    for col in pdf.columns:
        exp = pdf[col].dropna().quantile([.25, .5, .75, .9]).tolist()
        assert [got[col][k] for k in ("q1", "med", "q3", "p9")] == pytest.approx(exp, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("rpb", [2_000_000, 30])
def test_average_ranks_match_pandas(frame, rpb):
    pdf, sdf = frame
    lg = numeric_long(sdf, ["a"])
    rt = ranks.rank_table(lg, ["column"], rows_per_bucket=rpb).toPandas().set_index("value")["avg_rank"]
    exp = pdf["a"].rank(method="average")
    assert np.allclose(pdf["a"].map(rt).to_numpy(), exp.to_numpy())


def test_numeric_summary_matches_pandas(frame):
    pdf, sdf = frame
    s = {r["column"]: r for r in P.numeric_summary(sdf, list(pdf.columns), with_shapiro=False).collect()}
    for col in pdf.columns:
        x = pdf[col].dropna()
        r = s[col]
        assert r["count"] == len(x)
        assert r["mean"] == pytest.approx(round(x.mean(), 4), abs=1e-4)
        assert r["std"] == pytest.approx(round(x.std(), 4), abs=1e-4)
        assert r["skewness"] == pytest.approx(round(x.skew(), 4), abs=1e-4)
        assert r["kurtosis"] == pytest.approx(round(x.kurt(), 4), abs=1e-4)
        q1, q3 = x.quantile(.25), x.quantile(.75)
        out = ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
        assert r["iqr_outlier_count"] == out
        z = ((x - x.mean()).abs() > 3 * x.std(ddof=0)).sum()
        assert r["zscore_outlier_count"] == z


def test_semantic_types_edge_table(spark):
    pdf = pd.DataFrame({
        "const": [1] * 60, "flag": [0, 1] * 30, "yes no": ["yes", "no"] * 30, "row_id": list(range(60)),
        "cat": ["x", "y", "z"] * 20, "txt": [("word " * 15) + str(i) for i in range(60)],
        "ordinal": [i % 5 for i in range(60)], "cont": [i * 1.37 for i in range(60)],
        "when": ["2024-01-%02d" % (i % 28 + 1) for i in range(60)],
    })
    got = {r["column"]: r["semantic_type"] for r in P.semantic_types(spark.createDataFrame(pdf)).collect()}
    assert got == {"const": "constant", "flag": "boolean", "yes no": "boolean", "row_id": "id", "cat": "categorical",
                   "txt": "text", "ordinal": "ordinal_or_categorical_numeric", "cont": "continuous",
                   "when": "datetime_string"}


def test_profile_empty_and_all_null(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, y string")
    p = {r["column"]: r for r in P.profile_columns(df).collect()}
    assert p["x"]["semantic_type"] == "constant" and p["x"]["missing_count"] == 2
    empty = spark.createDataFrame([], "x double, y string")
    assert P.profile_columns(empty).count() == 2


def test_profile_invariant_to_partitioning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    a = sorted(map(tuple, P.profile_columns(df.repartition(1), with_shapiro=False).drop("pos").collect()), key=str)
    b = sorted(map(tuple, P.profile_columns(df.repartition(7), with_shapiro=False).drop("pos").collect()), key=str)
    assert a == b
