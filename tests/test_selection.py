"""Quantiles by bracketed selection against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.operators.selection import bracketed_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    parts = {"unique": rng.normal(size=20_000), "hot": np.where(rng.random(20_000) < 0.9, 7.0, rng.normal(size=20_000)),
             "few": rng.integers(0, 11, 20_000) / 100, "constant": np.full(500, 2.5), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    return pd.concat([pd.DataFrame({"column": k, "value": v}) for k, v in parts.items()])


@pytest.mark.parametrize(("accuracy", "rows_per_bucket"), [(10_000, 2_000_000), (50, 2_000_000), (50, 40)])
def test_equal_to_pandas(spark, frame, accuracy, rows_per_bucket):
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("none", None)], "column string, value double")).repartition(6)
    got = {(r["column"], r["p"]): r["q"] for r in bracketed_quantiles(df, PROBS, accuracy=accuracy, rows_per_bucket=rows_per_bucket).collect()}
    want = {(k, p): v.quantile(p) for k, v in frame.groupby("column")["value"] for p in PROBS}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)


def test_only_rows_inside_brackets_are_shuffled(spark, frame):
    df = spark.createDataFrame(frame[frame["column"] == "unique"])
    inside = bracketed_quantiles(df, [0.5], accuracy=1000)
    assert inside.first()["q"] == pytest.approx(frame[frame["column"] == "unique"]["value"].median())
    lo, hi = df.select(F.percentile_approx("value", [0.498, 0.502], 1000)).first()[0]
    assert df.where(F.col("value").between(lo, hi)).count() < 0.01 * df.count()
