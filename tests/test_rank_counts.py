"""Rank tests and chi-square on hot values, unique texts and NULLs, against brute force."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest

from tabprobe.operators import ranks
from tabprobe.operators import stats as S


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    n = 4000
    x = rng.normal(size=n)
    d = pd.DataFrame({"unique": x, "hot": np.where(rng.random(n) < 0.9, 3.0, x), "few": np.round(x), "holes": np.where(rng.random(n) < 0.2, np.nan, x + rng.normal(size=n)),
                      "y": np.where(rng.random(n) < 0.6, 0.0, x * x * np.sign(x) + rng.normal(size=n))})
    return d


def rho(a, b):
    both = a.notna() & b.notna()
    return np.corrcoef(a[both].rank(), b[both].rank())[0, 1]


@pytest.mark.parametrize("rows_per_bucket", [2_000_000, 150])
def test_spearman_with_hot_values_and_holes(spark, frame, rows_per_bucket):
    df = spark.createDataFrame(frame).repartition(5)
    feats = ["unique", "hot", "few", "holes"]
    got = {r["column"]: (r["n"], r["rho"]) for r in S.spearman_test(df, feats, "y", rows_per_bucket=rows_per_bucket).collect()}
    for f in feats:
        assert got[f] == (frame[f].notna().sum(), pytest.approx(rho(frame[f], frame["y"]), abs=1e-9))


def test_ranks_of_hot_values_are_attached(spark, frame):
    df = spark.createDataFrame(frame[["hot", "few"]]).repartition(4)
    for heavy in (4, 1000):
        got = ranks.attach_ranks(df, "hot", [], "r", heavy=heavy).toPandas()
        assert len(got) == len(frame)
        assert np.allclose(got["r"], got["hot"].rank()) and sorted(got["hot"]) == sorted(frame["hot"])


def test_feature_values_are_not_joined_to_rows(spark, frame):
    plan = S.spearman_test(spark.createDataFrame(frame), ["unique", "hot"], "y")._jdf.queryExecution().toString()
    joins = [line for line in plan.split("== Physical Plan ==")[-1].splitlines() if re.search(r"(SortMerge|ShuffledHash|BroadcastHash)Join", line)]
    assert joins and not any(re.search(r"\bvalue#", line) for line in joins)


def test_collinearity_with_holes(spark, frame):
    cols = ["unique", "few", "holes", "hot"]
    got = {(r.col_a, r.col_b): r.rho for r in S.spearman_collinearity(spark.createDataFrame(frame), cols, threshold=0.0).collect()}
    assert len(got) == 6
    for (a, b), v in got.items():
        assert v == pytest.approx(rho(*(frame.loc[frame[a].notna() & frame[b].notna(), c] for c in (a, b))), abs=1e-9)


def brute_chi(level, cls):
    t = pd.crosstab(level, cls).to_numpy().astype(float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    diff = np.abs(t - e)
    dof = (t.shape[0] - 1) * (t.shape[1] - 1)
    if dof == 1:
        diff = diff - np.minimum(0.5, diff)
    return (diff**2 / e).sum(), dof, 100 * (e < 5).mean()


def test_chi_square_from_present_cells(spark):
    rng = np.random.default_rng(2)
    n = 3000
    d = pd.DataFrame({"wide": rng.integers(0, 200, n).astype(str), "two": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "rare": np.where(rng.random(n) < 0.002, "r", "s")})
    d["cls"] = np.where(rng.random(n) < 0.2, d["two"], rng.choice(["a", "b", "c"], n, p=[0.5, 0.45, 0.05]))
    d["bin"] = np.where(d["cls"] == "a", "a", "z")
    df = spark.createDataFrame(d)
    for target in ("cls", "bin"):
        for r in S.chi_square(df, ["wide", "two", "rare"], target).collect():
            chi, dof, low = brute_chi(d[r["column"]], d[target])
            assert (r.statistic, r.dof, r.pct_cells_low_expected) == (pytest.approx(chi, rel=1e-9, abs=1e-9), dof, pytest.approx(low))


def test_chi_square_of_unique_texts_has_no_grid(spark):
    df = spark.range(20_000).selectExpr("concat('text ', id) AS t", "concat('c', id % 50) AS k")
    r = S.chi_square(df, ["t"], "k").first()
    assert r.statistic == pytest.approx(20_000 * 49) and r.dof == 19_999 * 49 and r.pct_cells_low_expected == 100
    assert S.contingency(df, ["t"], "k").count() == 20_000


def test_warnings(spark):
    schema = "feature string, significant boolean, significant_after_fdr boolean, effect_label string, p_value double, expected_freq_assumption_ok boolean, pct_cells_low_expected double"
    rows = [(f"lost{i}", True, False, "small", 0.04, None, None) for i in range(4)]
    rows += [("tiny", True, True, "negligible", 1e-9, None, None), ("thin", False, False, "small", 0.5, False, 40.0), ("bent", False, False, "small", 0.6, True, 0.0)]
    ranked = spark.createDataFrame(rows, schema)
    signals = spark.createDataFrame([("bent", True), ("thin", False)], "feature string, nonlinear boolean")
    pairs = spark.createDataFrame([("a", "b", 50, 0.91)], "col_a string, col_b string, n long, rho double")
    got = {tuple(r) for r in S.stats_warnings(ranked, signals, pairs).collect()}
    assert got == {("lost_after_fdr", None, None, 4.0), ("nonlinear", "bent", None, None), ("low_expected", "thin", None, 40.0),
                   ("negligible_but_significant", "tiny", None, None), ("collinear", "a", "b", 0.91)}
    quiet = S.stats_warnings(ranked.where("feature IN ('thin', 'bent')").withColumn("expected_freq_assumption_ok", ranked.significant), signals.limit(0))
    assert {r.code for r in quiet.collect()} == {"none_significant", "low_expected"}
