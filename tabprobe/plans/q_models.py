"""Registered queries for split / baselines / evaluation (G) and tuning / trial log (H)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tabprobe.functions.columns import r4
from tabprobe.functions.keyhash import fold_of, is_test, sql_fold, sql_hash, sql_is_test
from tabprobe.operators import features as X
from tabprobe.operators import models as M
from tabprobe.operators import profile as P
from tabprobe.operators import stats as S
from tabprobe.operators import tuning as H
from tabprobe.operators.naive_bayes import GaussianNB
from tabprobe.operators.profile import _freeze
from tabprobe.plans.registry import register
from tabprobe.plans.signals import measured_signals
from tabprobe.session import ensure_checkpoint_dir
from tabprobe.sources.tables import fixture, fixture_cte, table

_PREPARED: dict = {}


def prepared(spark, sf, name: str, target: str, key: str, problem: str):
    """Split by key hash, profile and test on the training rows, fit the FeatureModel there, apply to all rows.

    The result is checkpointed into spark.checkpoint.dir (lineage cut, survives
    executor loss) and reused by the model and tuning queries of this process.
    """
    k = (id(spark), sf, name)
    if k in _PREPARED:
        return _PREPARED[k]
    ensure_checkpoint_dir(spark)
    rows = M.split(fixture(spark, sf, name), [key])
    df = M.spread(rows, rows.count()).persist(StorageLevel.MEMORY_AND_DISK)  # joined once, not by each test
    train = df.where(~F.col("is_test")).drop("is_test")
    prof = P.profile_columns(train, target=target, with_shapiro=False)
    tests = S.test_features(train, target, problem)
    signals, pairs = measured_signals(train, target, [key], problem, tests)
    model = X.fit(train, target, [key], profile=prof, signals=signals, collinear_pairs=pairs)
    tr = model.transform(train, training=True).withColumn("is_test", F.lit(False))
    te = model.transform(df.where(F.col("is_test")).drop("is_test")).withColumn("is_test", F.lit(True))
    tests = _freeze(tests)  # a row a feature
    out = tr.unionByName(te).checkpoint()
    df.unpersist()
    _PREPARED[k] = (out, model, tests)
    return _PREPARED[k]


# ── G ─────────────────────────────────────────────────────────────────────────

@register("g1_split", f"SELECT o_orderkey, {sql_is_test('o_orderkey')} AS is_test FROM orders")
def g1_split(spark, sf):
    return M.split(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


_RANKED = (f"SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash('o_orderkey')}, o_orderkey) - 1 AS r, "
           "count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders")


@register("g1_stratified_split", f"SELECT o_orderkey, r < (n * 20 + 50) // 100 AS is_test FROM ({_RANKED})")
def g1_stratified_split(spark, sf):
    """A fifth of each order status, to one row."""
    return M.stratified_split(table(spark, sf, "orders"), ["o_orderkey"], "o_orderstatus").select("o_orderkey", "is_test")


@register("h2_stratified_folds", f"SELECT o_orderkey, CAST(r * 3 // n AS INTEGER) AS fold FROM ({_RANKED})")
def h2_stratified_folds(spark, sf):
    return M.stratified_folds(table(spark, sf, "orders"), ["o_orderkey"], "o_orderstatus", 3).select("o_orderkey", "fold")


_NB_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NB_TRAIN = f"NOT {sql_is_test('l_orderkey')}"
_NB_STATS = ", ".join(f"avg(CAST({x} AS DOUBLE)) AS m{i}, var_pop(CAST({x} AS DOUBLE)) AS v{i}" for i, x in enumerate(_NB_FEATURES))
_NB_SCORE = "ln(n / (SELECT sum(n) FROM f)) - " + " - ".join(
    f"0.5 * (ln(2 * pi() * (v{i} + e)) + (CAST({x} AS DOUBLE) - m{i}) * (CAST({x} AS DOUBLE) - m{i}) / (v{i} + e))" for i, x in enumerate(_NB_FEATURES))


@register("i_gaussian_nb", f"""
WITH f AS (SELECT l_returnflag AS label, count(*) AS n, {_NB_STATS} FROM lineitem WHERE {_NB_TRAIN} GROUP BY 1),
     w AS (SELECT 1e-9 * greatest({", ".join(f"var_pop(CAST({x} AS DOUBLE))" for x in _NB_FEATURES)}) AS e FROM lineitem WHERE {_NB_TRAIN}),
     t AS (SELECT *, row_number() OVER () AS i FROM lineitem WHERE {sql_is_test('l_orderkey')}),
     s AS (SELECT i, l_orderkey, l_linenumber, label, {_NB_SCORE} AS score FROM t, f, w)
SELECT l_orderkey, l_linenumber, arg_max(label, score) AS prediction FROM s GROUP BY i, l_orderkey, l_linenumber""")
def i_gaussian_nb(spark, sf):
    """Gaussian naive Bayes of the return flag on four numbers, fitted on training orders, for all held-out lines."""
    df = M.split(table(spark, sf, "lineitem"), ["l_orderkey"])
    train = df.where(~F.col("is_test"))
    classes = M.label_index(train, "l_returnflag")
    d = M.with_label(df, "l_returnflag", classes).withColumn("features", F.array(*[F.col(x).cast("double") for x in _NB_FEATURES]))
    out = GaussianNB().fit(d.where(~F.col("is_test"))).transform(d.where(F.col("is_test")))
    name = F.element_at(F.array(*[F.lit(x) for x in classes]), F.col("prediction").cast("int") + 1)
    return out.select("l_orderkey", "l_linenumber", name.alias("prediction"))


@register("g2_class_balance", fixture_cte("fx_quality") + """
SELECT class, count, round(CAST(min(count) OVER () AS DOUBLE) / max(count) OVER (), 4) AS ratio,
       CASE WHEN CAST(min(count) OVER () AS DOUBLE) / max(count) OVER () < 0.35 THEN 'f1_weighted' ELSE 'accuracy' END AS metric
FROM (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS count FROM fx_quality WHERE quality IS NOT NULL GROUP BY 1)""")
def g2_class_balance(spark, sf):
    return M.class_balance(fixture(spark, sf, "fx_quality"), "quality")


@register("g4_balanced_weights", fixture_cte("fx_quality") + """
SELECT doc_id, round(CAST((SELECT count(*) FROM fx_quality WHERE quality IS NOT NULL) AS DOUBLE)
       / ((SELECT count(DISTINCT quality) FROM fx_quality) * c.n), 4) AS weight
FROM fx_quality f JOIN (SELECT quality, count(*) AS n FROM fx_quality GROUP BY quality) c USING (quality)""")
def g4_balanced_weights(spark, sf):
    w = M.balanced_weights(fixture(spark, sf, "fx_quality"), "quality")
    return w.select("doc_id", r4(F.col("weight")).alias("weight"))


@register("g5_dummy_classifier", fixture_cte("fx_quality") + f"""
SELECT doc_id, (SELECT first(v ORDER BY cnt DESC, v) FROM (SELECT CAST(quality AS VARCHAR) AS v, count(*) AS cnt FROM fx_quality
                 WHERE NOT {sql_is_test('doc_id')} AND quality IS NOT NULL GROUP BY 1)) AS prediction
FROM fx_quality WHERE {sql_is_test('doc_id')}""")
def g5_dummy_classifier(spark, sf):
    df = M.split(fixture(spark, sf, "fx_quality"), ["doc_id"])
    mode = M.dummy_classifier(df.where(~F.col("is_test")), "quality")
    return df.where(F.col("is_test")).select("doc_id", F.lit(mode).alias("prediction"))


@register("g6_dummy_regressor", fixture_cte("fx_brand") + f"""
SELECT p_partkey, round((SELECT avg(p_retailprice) FROM fx_brand WHERE NOT {sql_is_test('p_partkey')}), 4) AS prediction
FROM fx_brand WHERE {sql_is_test('p_partkey')}""")
def g6_dummy_regressor(spark, sf):
    df = M.split(fixture(spark, sf, "fx_brand"), ["p_partkey"])
    m = M.dummy_regressor(df.where(~F.col("is_test")), "p_retailprice")
    return df.where(F.col("is_test")).select("p_partkey", r4(F.lit(m)).alias("prediction"))


REPORT_SQL = fixture_cte("fx_predictions") + """,
cc AS (SELECT CAST(label AS VARCHAR) AS label, CAST(prediction AS VARCHAR) AS prediction, count(*) AS cnt FROM fx_predictions GROUP BY 1, 2),
sup AS (SELECT label AS class, sum(cnt) AS support FROM cc GROUP BY 1),
pp AS (SELECT prediction AS class, sum(cnt) AS predicted FROM cc GROUP BY 1),
tp AS (SELECT label AS class, cnt AS tp FROM cc WHERE label = prediction),
rep AS (SELECT coalesce(sup.class, pp.class) AS class, coalesce(tp.tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
        FROM sup FULL JOIN pp USING (class) LEFT JOIN tp ON tp.class = coalesce(sup.class, pp.class)),
rep2 AS (SELECT class, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall, CAST(support AS BIGINT) AS support FROM rep),
rep3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rep2)
"""


@register("g14_classification_report", REPORT_SQL + "SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM rep3")
def g14_classification_report(spark, sf):
    r = M.classification_report(fixture(spark, sf, "fx_predictions"))
    return r.select("class", r4(F.col("precision")).alias("precision"), r4(F.col("recall")).alias("recall"),
                    r4(F.col("f1")).alias("f1"), "support")


@register("g14_confusion_matrix", REPORT_SQL + "SELECT label, prediction, cnt AS count FROM cc")
def g14_confusion_matrix(spark, sf):
    return M.confusion_counts(fixture(spark, sf, "fx_predictions"))


@register("g9_classification_metrics", REPORT_SQL + """
SELECT round((SELECT CAST(sum(CASE WHEN label = prediction THEN cnt ELSE 0 END) AS DOUBLE) / sum(cnt) FROM cc), 4) AS accuracy,
       round(sum(f1 * support) / sum(support), 4) AS f1_weighted FROM rep3""")
def g9_classification_metrics(spark, sf):
    m = M.classification_metrics(fixture(spark, sf, "fx_predictions"))
    return m.select(r4(F.col("accuracy")).alias("accuracy"), r4(F.col("f1_weighted")).alias("f1_weighted"))


REG_SQL = fixture_cte("fx_predictions") + """,
rm AS (SELECT avg((y - y_hat) * (y - y_hat)) AS mse, avg(abs(y - y_hat)) AS mae, var_pop(y) AS vy FROM fx_predictions)
"""


@register("g10_regression_metrics", REG_SQL + """
SELECT round(CASE WHEN vy > 0 THEN 1 - mse / vy ELSE 0 END, 4) AS r2, round(mae, 4) AS mae, round(sqrt(mse), 4) AS rmse FROM rm""")
def g10_regression_metrics(spark, sf):
    m = M.regression_metrics(fixture(spark, sf, "fx_predictions"), "y", "y_hat")
    return m.select(r4(F.col("r2")).alias("r2"), r4(F.col("mae")).alias("mae"), r4(F.col("rmse")).alias("rmse"))


@register("g13_needs_tuning", REPORT_SQL + """,
m AS (SELECT (SELECT CAST(sum(CASE WHEN label = prediction THEN cnt ELSE 0 END) AS DOUBLE) / sum(cnt) FROM cc) AS accuracy,
             sum(f1 * support) / sum(support) AS f1_weighted FROM rep3)
SELECT 'accuracy' AS metric, round(accuracy, 4) AS score, NOT accuracy > 0.8 AS needs_tuning FROM m
UNION ALL SELECT 'f1_weighted', round(f1_weighted, 4), NOT f1_weighted > 0.8 FROM m""")
def g13_needs_tuning(spark, sf):
    m = M.classification_metrics(fixture(spark, sf, "fx_predictions")).first()
    rows = [(k, round(m[k], 4), M.needs_tuning(m[k], k)) for k in ("accuracy", "f1_weighted")]
    return spark.createDataFrame(rows, "metric string, score double, needs_tuning boolean")


@register("g15_residual_table", fixture_cte("fx_predictions") + f"""
SELECT o_orderkey, round(y, 4) AS actual, round(y_hat, 4) AS predicted, round(y - y_hat, 4) AS residual
FROM fx_predictions""")
def g15_residual_table(spark, sf):
    r = M.residual_table(fixture(spark, sf, "fx_predictions"), "o_orderkey", "y", "y_hat")
    return r.select("o_orderkey", *[r4(F.col(x)).alias(x) for x in ("actual", "predicted", "residual")])


def _leaderboard(spark, sf, name="fx_quality", target="quality", key="doc_id", problem="classification"):
    out, model, tests = prepared(spark, sf, name, target, key, problem)
    n_sig = tests.where(F.col("significant_after_fdr")).count()
    return M.baseline_leaderboard(out, model.columns, target, problem, n_significant=n_sig)


@register("g11_baseline_leaderboard")
def g11_baseline_leaderboard(spark, sf):
    """G7 + G11: logistic, ridge-OvR and tree baselines on prepared fx_quality (imbalanced → balanced variants too)."""
    lb, summary = _leaderboard(spark, sf)
    return lb.withColumn("winner", F.col("model") == F.lit(summary["best_model"]))


@register("g8_baseline_regressors")
def g8_baseline_regressors(spark, sf):
    """Linear, ridge, lasso and tree baselines on prepared fx_brand (target p_retailprice)."""
    lb, _ = _leaderboard(spark, sf, "fx_brand", "p_retailprice", "p_partkey", "regression")
    return lb


@register("g12_imbalance_comparison")
def g12_imbalance_comparison(spark, sf):
    lb, _ = _leaderboard(spark, sf)
    return M.imbalance_comparison(lb)


@register("g3_model_context")
def g3_model_context(spark, sf):
    out, model, tests = prepared(spark, sf, "fx_quality", "quality", "doc_id", "classification")
    ctx = M.model_context(out.where(~F.col("is_test")).count(), len(model.columns),
                          tests.where(F.col("significant_after_fdr")).count(), "classification")
    return spark.createDataFrame([tuple(ctx.values())], "n_rows long, n_features long, n_significant long, high_dimensional boolean")


@register("g7_ada_boost_classifier")
def g7_ada_boost_classifier(spark, sf):
    """SAMME AdaBoost (10 weighted stumps) on prepared fx_status; accuracy and weighted F1 on held-out rows."""
    from tabprobe.operators.boosting import ada_boost_fit
    out, model, _ = prepared(spark, sf, "fx_status", "o_orderstatus", "o_orderkey", "classification")
    classes = M.label_index(out.where(~F.col("is_test")), "o_orderstatus")
    d = M.assemble(M.with_label(out, "o_orderstatus", classes), model.columns)
    ada = ada_boost_fit(d.where(~F.col("is_test")), len(classes), n_estimators=10, learning_rate=0.5)
    m = M.classification_metrics(ada.transform(d.where(F.col("is_test"))))
    return m.withColumn("rounds", F.lit(len(ada.stumps)).cast("long"))


@register("g16_feature_importance")
def g16_feature_importance(spark, sf):
    """Tree importances of a depth-6 tree refit on all prepared fx_status rows."""
    out, model, _ = prepared(spark, sf, "fx_status", "o_orderstatus", "o_orderkey", "classification")
    classes = M.label_index(out, "o_orderstatus")
    d = M.assemble(M.with_label(out, "o_orderstatus", classes), model.columns)
    tree = M.classifier_candidates(d.count(), False, 0)["decision_tree"].fit(d)
    return M.feature_importance(tree, model.columns, spark)


@register("g17_refit_and_predict")
def g17_refit_and_predict(spark, sf):
    """The leaderboard's winner on fx_status, refitted on all training rows: id and prediction of every held-out row."""
    out, model, _ = prepared(spark, sf, "fx_status", "o_orderstatus", "o_orderkey", "classification")
    _, summary = _leaderboard(spark, sf, "fx_status", "o_orderstatus", "o_orderkey")
    pred = M.refit_and_predict(out.where(~F.col("is_test")), out.where(F.col("is_test")), model.columns, "o_orderstatus", "classification", summary)
    return pred.select("o_orderkey", "prediction")


@register("g18_gain_over_baseline")
def g18_gain_over_baseline(spark, sf):
    """Tuned (smoke search) best holdout score minus the best baseline score on fx_quality."""
    lb, summary = _leaderboard(spark, sf)
    return H.gain_over_baseline(_trials(spark, sf), summary)


# ── H ─────────────────────────────────────────────────────────────────────────

@register("h2_cv_folds", f"SELECT o_orderkey, {sql_fold('o_orderkey', 3)} AS fold FROM orders")
def h2_cv_folds(spark, sf):
    return H.cv_folds(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "fold")


_TRIALS: dict = {}


def _trials(spark, sf):
    k = (id(spark), sf)
    if k not in _TRIALS:
        out, model, _ = prepared(spark, sf, "fx_quality", "quality", "doc_id", "classification")
        _TRIALS[k] = H.run_trials(out, model.columns, "quality", ["doc_id"], "classification",
                                  families=["logistic_regression", "decision_tree_classifier", "gaussian_nb",
                                            "random_forest_classifier"], mode="smoke_test").cache()
    return _TRIALS[k]


@register("h3_run_trials")
def h3_run_trials(spark, sf):
    """Smoke-mode search (one draw per family and strategy), 3-fold CV plus holdout, on prepared fx_quality."""
    return _trials(spark, sf)


@register("h4_best_per_model")
def h4_best_per_model(spark, sf):
    return H.best_per_model(_trials(spark, sf))


@register("h8_tuning_report")
def h8_tuning_report(spark, sf):
    """Winner, its parameters, CV and holdout score, and the per-family best table."""
    return H.tuning_report(_trials(spark, sf))


@register("h10_reuse_best_params")
def h10_reuse_best_params(spark, sf):
    """Log the trials as two runs in the checkpoint folder, read back, pick the best run's best params per model."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/trial-log-{uuid.uuid4().hex}"
    t = _trials(spark, sf)
    H.log_trials(t.where(F.col("strategy") == "unweighted"), base, "run1")
    logged = H.log_trials(t.where(F.col("strategy") == "balanced"), base, "run2")
    long = logged.select("run_id", "model_id", "trial_index", "cv_score", F.explode("params").alias("param_name", "param_value"))
    return H.reuse_best_params(long)
