"""Preparation: batched power transforms, odd column names, NULLs in new data, stored models, resumed streams."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import features as X
from tabprobe.operators import models as M
from tabprobe.operators import profile as P
from tabprobe.streaming.apply_stream import apply_model_stream, file_stream


def likelihood(x, lam):
    with np.errstate(all="ignore"):
        y = np.where(x >= 0, np.log1p(np.abs(x)) if abs(lam) < 1e-12 else ((np.abs(x) + 1) ** lam - 1) / lam,
                     -np.log1p(np.abs(x)) if abs(lam - 2) < 1e-12 else -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam))
    return -len(x) / 2 * math.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_lambdas_of_all_columns_in_the_jobs_of_one(spark):
    rng = np.random.default_rng(5)
    data = {"a": rng.exponential(2, 400), "b c": rng.normal(size=400), "d.e": -rng.exponential(1, 400) ** 2}
    df = spark.createDataFrame([tuple(map(float, r)) + (None,) for r in zip(*data.values(), strict=True)], "a double, `b c` double, `d.e` double, none double")
    got = X.yeo_johnson_lambdas(df, [*data, "none"])
    for k, x in data.items():
        best = max(np.arange(-4, 6, 0.01), key=lambda lam: likelihood(x, lam))
        assert got[k] == pytest.approx(best, abs=0.03) and likelihood(x, got[k]) > likelihood(x, best) - 0.05
    assert got["none"] == 1.0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, rng.expovariate(1), rng.gauss(0, 1), rng.choice(["x", "y", "z"]), f"v{rng.randrange(60)}", float(i % 2)) for i in range(400)]
    return spark.createDataFrame(data, "id long, `size.cm` double, `b c` double, few string, `many.levels` string, y double").repartition(3)


@pytest.fixture(scope="module")
def model(rows):
    return X.fit(rows, "y", ["id"], profile=P.profile_columns(rows, target="y", with_shapiro=False),
                 plan={"many.levels": {"action": "encode", "method": "target_encode"}})


def test_dotted_names_and_new_nulls(spark, rows, model):
    assert any("size.cm" in x for x in model.columns)
    hole = rows.select("id", F.lit(None).cast("double").alias("size.cm"), F.lit(None).cast("double").alias("b c"),
                       F.lit(None).cast("string").alias("few"), F.lit(None).cast("string").alias("many.levels"), "y")
    out = model.transform(hole)
    assert out.where(" OR ".join(f"`{x}` IS NULL" for x in model.columns)).count() == 0
    assert M.assemble(out, model.columns).select("features").first()["features"].size == len(model.columns)


def test_stored_model_gives_equal_rows(spark, rows, model, tmp_path):
    path = str(tmp_path / "model")
    model.save(spark, path)
    loaded = X.FeatureModel.load(spark.newSession(), path)
    assert loaded.columns == model.columns and loaded.steps == model.steps
    key = lambda r: r["id"]
    for training in (False, True):
        want = sorted(model.transform(rows, training=training).collect(), key=key)
        assert sorted(X.FeatureModel.load(spark, path).transform(rows, training=training).collect(), key=key) == want


def test_stream_of_a_loaded_model_resumes(spark, rows, model, tmp_path):
    path, files = str(tmp_path / "model"), str(tmp_path / "in")
    model.save(spark, path)
    loaded = X.FeatureModel.load(spark, path)
    name = f"resume-{random.getrandbits(60)}"
    for part in range(4):
        rows.where(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(files)
        if part in (1, 3):  # two files a run, a batch a file; the second run goes on where the first ended
            out = apply_model_stream(spark, loaded, file_stream(spark, files, "*.parquet", rows.schema), name)
            assert out.count() == rows.where(F.col("id") % 4 <= part).count()
    key = lambda r: r["id"]
    assert sorted(out.collect(), key=key) == sorted(model.transform(rows).collect(), key=key)
