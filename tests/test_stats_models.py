"""Tests, FDR, encoders and trial queries on hand-built tables and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import features as X
from tabprobe.operators import models as M
from tabprobe.operators import stats as S
from tabprobe.operators import tuning as H
from tabprobe.sources.tables import FIXTURES


def test_chi_square_yates_2x2(spark):
    rows = [("a", "p")] * 10 + [("a", "q")] * 20 + [("b", "p")] * 25 + [("b", "q")] * 15
    df = spark.createDataFrame(rows, "f string, t string")
    r = S.chi_square(df, ["f"], "t").first()
    assert r["statistic"] == pytest.approx(4.725, abs=1e-3)   # Yates-corrected; Pearson would be 5.8333
    assert r["dof"] == 1


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": np.round(rng.normal(0, 1, 300), 1), "g": rng.choice(["a", "b", "c"], 300)})
    return pdf, spark.createDataFrame(pdf)


def test_kruskal_matches_brute_force(groups):
    pdf, sdf = groups
    r = pdf["x"].rank()
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(r[pdf.g == k].sum() ** 2 / (pdf.g == k).sum() for k in "abc") - 3 * (n + 1)
    t = pdf["x"].value_counts()
    h /= 1 - ((t ** 3 - t).sum()) / (n ** 3 - n)
    got = S.kruskal(sdf, ["x"], "g").first()
    assert got["h"] == pytest.approx(h, rel=1e-10)


def test_mann_whitney_matches_brute_force(groups):
    pdf, sdf = groups
    two = pdf[pdf.g != "c"]
    r = two["x"].rank()
    n1 = (two.g == "a").sum()
    u1 = r[two.g == "a"].sum() - n1 * (n1 + 1) / 2
    got = S.mann_whitney(sdf.where(F.col("g") != "c"), ["x"], "g").first()
    assert got["u"] == pytest.approx(u1)


def test_anova_and_welch(groups):
    pdf, sdf = groups
    k = pdf.groupby("g")["x"]
    gm = pdf.x.mean()
    ssb = (k.count() * (k.mean() - gm) ** 2).sum()
    ssw = ((k.count() - 1) * k.var()).sum()
    f = (ssb / 2) / (ssw / (len(pdf) - 3))
    assert S.anova_oneway(sdf, ["x"], "g").first()["f"] == pytest.approx(f, rel=1e-10)


def test_bh_matches_reference_procedure(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature string, p_value double")
    got = {r["feature"]: r for r in S.bh_fdr(df).collect()}
    n = len(p)
    adj = np.minimum(1, np.array(p) * n / np.arange(1, n + 1))
    adj = np.minimum.accumulate(adj[::-1])[::-1]
    crit = np.array(p) <= np.arange(1, n + 1) / n * 0.05
    kmax = np.where(crit)[0].max()
    for i in range(n):
        assert got[f"f{i}"]["p_adjusted"] == pytest.approx(adj[i])
        assert got[f"f{i}"]["significant_after_fdr"] == (i <= kmax)


def test_mutual_information_categorical_exact(spark):
    rows = [("a", "0")] * 30 + [("a", "1")] * 10 + [("b", "0")] * 5 + [("b", "1")] * 55
    df = spark.createDataFrame(rows, "f string, t string")
    ct = pd.crosstab(pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows])).to_numpy() / len(rows)
    mi = (ct * np.log(ct / ct.sum(1, keepdims=True) / ct.sum(0, keepdims=True))).sum()
    got = S.mutual_information(df, [], ["f"], "t").first()["mi"]
    assert got == pytest.approx(mi, rel=1e-12)


def test_target_encoding_is_out_of_fold(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.arange(500), "lvl": rng.choice(list("abcdefg"), 500), "y": rng.normal(size=500)})
    df = spark.createDataFrame(pdf)
    fitted = X.target_encode_fit(df, "lvl", "y", ["k"])
    enc = X.target_encode_train(df, "lvl", ["k"], fitted).toPandas().set_index("k")["lvl_te"]
    from tabprobe.functions.keyhash import fold_of
    folds = df.select("k", fold_of(F.col("k"), 5).alias("f")).toPandas().set_index("k")["f"]
    pdf["f"] = pdf.k.map(folds)
    for _, row in pdf.sample(40, random_state=1).iterrows():
        other = pdf[(pdf.lvl == row.lvl) & (pdf.f != row.f)]
        assert enc[row.k] == pytest.approx(other.y.mean())  # never its own fold's target


def test_unseen_levels_and_alignment(spark):
    train = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i)) for i in range(40)], "k long, c string, y double")
    model = X.FeatureModel("y", ["k"], one_hot={"c": ["a", "b"]}, freq={}, columns=["c_b", "extra"])
    new = spark.createDataFrame([(100, "zzz", 1.0)], "k long, c string, y double")
    r = model.transform(new).first()
    assert r["c_b"] == 0.0 and r["extra"] == 0.0
    t, lv = X.frequency_table(train, "c")
    assert X.frequency_encode(new, "c", t, lv).first()["c_freq"] == 0.0


def test_key_hash_split_share(spark):
    df = M.split(spark.range(0, 20000).withColumnRenamed("id", "k"), ["k"])
    share = df.where("is_test").count() / 20000
    assert 0.18 < share < 0.22


def _trials_fixture(spark):
    return spark.sql(FIXTURES["fx_trials"]).withColumn("cv_score", F.col("cv_score").cast("double"))


def test_best_per_model_on_literal_trials(spark):
    got = {r["model_id"]: (r["run_id"], r["trial_index"], r["cv_score"]) for r in H.best_per_model(_trials_fixture(spark)).collect()}
    assert got == {"ridge": ("run1", 2, 0.66), "tree": ("run2", 1, 0.66), "forest": ("run2", 1, 0.71)}


def test_reuse_best_params_on_literal_trials(spark):
    got = H.reuse_best_params(_trials_fixture(spark)).collect()
    assert {(r["run_id"], r["model_id"], r["param_value"]) for r in got} == {("run2", "tree", "8"), ("run2", "forest", "sqrt")}
    typed = {r["param_value"]: r["typed"] for r in got}
    assert typed["8"]["as_int"] == 8 and typed["sqrt"]["as_string"] == "sqrt"


def test_search_space_draws_are_seeded_and_in_range():
    import random
    for fam, space in H.SPACES.items():
        a = H.sample_params(fam, random.Random(f"42:{fam}"))
        b = H.sample_params(fam, random.Random(f"42:{fam}"))
        assert a == b
        for name, spec in space.items():
            if spec[0] == "int":
                assert spec[1] <= a[name] <= spec[2]
            elif spec[0] == "float":
                assert spec[1] <= a[name] <= spec[2]


def test_metrics_on_known_predictions(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (2, 0)], "label int, prediction int")
    m = M.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(4 / 6)
    reg = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "label double, prediction double")
    r = M.regression_metrics(reg).first()
    assert r["mae"] == pytest.approx(1 / 3) and r["r2"] == pytest.approx(1 - (0.5 / 3) / (2 / 3))


def test_levene_matches_brute_force(groups):
    pdf, sdf = groups
    dev = (pdf.x - pdf.groupby("g").x.transform("median")).abs()
    k = dev.groupby(pdf.g)
    f = (k.count() * (k.mean() - dev.mean()) ** 2).sum() / 2 / (((k.count() - 1) * k.var()).sum() / (len(pdf) - 3))
    assert S.levene(sdf, ["x"], "g").first()["f"] == pytest.approx(f, rel=1e-9)


def test_normality_gate_reads_all_rows(spark):
    rng = np.random.default_rng(11)
    parts = {"normal": rng.normal(0, 1, 3000), "skewed": rng.exponential(1, 3000), "few": rng.normal(0, 1, 7),
             "constant": np.ones(50)}
    df = spark.createDataFrame([(k, "a", float(v)) for k, vs in parts.items() for v in vs], "column string, class string, value double")
    got = {r["column"]: r["normal"] for r in S.normality_gate(df, ["column", "class"]).collect()}
    assert got == {"normal": True, "skewed": False, "few": False, "constant": False}


def test_ada_boost_releases_its_rows(spark):
    from tabprobe.operators.boosting import ada_boost_fit
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.range(0, 200).select((F.col("id") % 20).cast("double").alias("x")).withColumn("label", (F.col("x") > 12).cast("double"))
    a = M.assemble(df, ["x"])
    assert ada_boost_fit(a, 2, n_estimators=6).transform(a).where("prediction <> label").count() == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
