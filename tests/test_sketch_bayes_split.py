"""Distinct sketches, Gaussian naive Bayes and stratified splits against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import models as M
from tabprobe.operators import sketches as K
from tabprobe.operators.naive_bayes import GaussianNB


def test_sketch_states_survive_storage_and_merge(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.col("id").alias("key"), (F.col("id") % 1000 / 8).alias("x"),
                                    F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("s"), F.lit(None).cast("string").alias("none"))
    cols = ["key", "x", "s", "none"]
    for day in range(7):
        K.distinct_states(df.where(F.col("day") == day), cols).write.parquet(str(tmp_path / f"day{day}"))
    stored = [spark.read.parquet(str(tmp_path / f"day{day}")) for day in range(7)]
    got = {r["column"]: r for r in K.distinct_estimates(K.merged_states(*stored)).collect()}
    whole = {r["column"]: r.approx_distinct for r in K.distinct_estimates(K.distinct_states(df, cols)).collect()}
    assert {c: r.approx_distinct for c, r in got.items()} == pytest.approx(whole, rel=0.01)
    for c, n in {"key": 60_000, "x": 1000, "s": 5, "none": 0}.items():
        assert abs(got[c].approx_distinct - n) <= 0.035 * n + 1
    assert got["s"].n == 40_000 and got["none"].n == 0
    parts = K.distinct_estimates(K.merged_states(K.distinct_states(df, ["key"], by="day"), keep_parts=True)).collect()
    assert len(parts) == 7 and all(abs(r.approx_distinct - 60_000 / 7) < 400 for r in parts)


def brute_nb(x, y, q, smoothing):
    eps = smoothing * x.var(axis=0).max()
    labels = np.unique(y)
    s = [np.log((y == k).mean()) - 0.5 * (np.log(2 * np.pi * (x[y == k].var(0) + eps)) + (q - x[y == k].mean(0)) ** 2 / (x[y == k].var(0) + eps)).sum(1)
         for k in labels]
    return labels[np.argmax(s, axis=0)]


def test_naive_bayes_is_the_formula(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 900).astype(float)
    x = rng.normal(size=(900, 4)) + y[:, None] * [0.5, 1.0, 0.0, 2.0] + [1e6, 0, 0, 0]
    x[y == 1, 2] = 0.25  # constant in a class
    df = spark.createDataFrame([(i, [float(v) for v in r], float(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "i int, features array<double>, label double")
    seen = []
    for smoothing in (1e-9, 0.5):
        got = [r.prediction for r in GaussianNB(smoothing).fit(df).transform(df).orderBy("i").collect()]
        assert (np.array(got) == brute_nb(x, y, x, smoothing)).mean() == 1
        seen.append(got)
    assert seen[0] != seen[1]
    one = df.withColumn("w", F.when(F.col("label") == 2, 3.0).otherwise(1.0))
    assert GaussianNB(weight="w").fit(one).prior[2] > 2 * GaussianNB().fit(df).prior[2] / 1.8


def test_stratified_shares(spark):
    data = [(i, "big") for i in range(5000)] + [(i, "small") for i in range(5000, 5013)] + [(6000, "one"), (6001, None), (6002, None), (6002, None)]
    df = spark.createDataFrame(data, "id long, t string").withColumn("t.x", F.lit(1)).repartition(5)
    split = M.stratified_split(df, ["id"], "t")
    n = {r.t: (r.n, r.k) for r in split.groupBy("t").agg(F.count("*").alias("n"), F.count_if("is_test").alias("k")).collect()}
    assert n == {"big": (5000, 1000), "small": (13, 3), "one": (1, 0), None: (3, 1)}
    folds = M.stratified_folds(df, ["id"], "t", 3).groupBy("t", "fold").count().collect()
    sizes = {t: sorted(r["count"] for r in folds if r.t == t) for t in ("big", "small", "one", None)}
    assert sizes == {"big": [1666, 1667, 1667], "small": [4, 4, 5], "one": [1], None: [1, 1, 1]}
    again = M.stratified_split(df.repartition(3), ["id"], "t").where("is_test AND t IS NOT NULL").select("id").collect()
    assert {r.id for r in again} == {r.id for r in split.where("is_test AND t IS NOT NULL").collect()}
    assert M.stratified_split(df.limit(0), ["id"], "t").count() == 0
