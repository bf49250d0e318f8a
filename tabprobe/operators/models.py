"""Split, baselines, evaluation (G1–G18) with Spark ML estimators.

Metrics are DataFrame aggregations over (label, prediction) — a confusion
count table for classification, one aggregation for regression — so scoring
is distributed like everything else. Splits and folds come from the key hash,
so they do not depend on partitioning or task retries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.columns import as_double, as_label, c, r4
from tabprobe.functions.joins import bounded_broadcast
from tabprobe.functions.keyhash import MOD, is_test, key_hash, row_key

# fixed values of the reference's rules
TEST_PCT = 20
IMBALANCE_METRIC_RATIO = 0.35
GOOD_ENOUGH = {"accuracy": 0.8, "f1_weighted": 0.8, "r2": 0.6}
TREE_DEPTH, TREE_LEAF = 6, 10
RIDGE_ALPHA, LASSO_ALPHA = 1.0, 0.001
# rows of a task while there are under MIN_TASKS, and beyond
FEW_ROWS, MANY_ROWS, MIN_TASKS = 16_000, 250_000, 24


def spread(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows dealt evenly over tasks for fitting; small tables stay as they are.

    Fitting costs far more a byte than a shuffle, so partitions that were merged by bytes would leave all trees to a few tasks.
    """
    tasks = max(math.ceil(n / MANY_ROWS), min(math.ceil(n / FEW_ROWS), MIN_TASKS))
    return df.repartition(tasks) if tasks > 1 else df


def split(df: DataFrame, key: Sequence[str], test_pct: int = TEST_PCT) -> DataFrame:
    """G1: add ``is_test`` from the key hash (≈ test_pct % of rows, of every class in expectation)."""
    return df.withColumn("is_test", is_test(row_key(key), test_pct))


def class_ranks(df: DataFrame, key: Sequence[str], target: str, buckets: int = 1024) -> DataFrame:
    """``df`` with ``class_row``, ``class_n``: the row's place (from 0) in its class by key hash, and the class's rows.

    The hash is cut into ``buckets`` ranges; rows are numbered in (class, range) and moved on by the sizes of the ranges
    before, so no task holds a class. A NULL target is a class of its own; equal keys are numbered in any order.
    """
    h = key_hash(row_key(key))
    d = df.withColumn("__k", as_label(df, target)).withColumn("__h", h).withColumn("__b", F.floor(h * buckets / MOD).cast("int"))
    d = d.withColumn("__key", row_key(key)).withColumn("__none", F.col("__k").isNull()).withColumn("__k", F.coalesce("__k", F.lit("")))
    sizes = d.groupBy("__none", "__k", "__b").agg(F.count("*").alias("__n"))
    mine = Window.partitionBy("__none", "__k")
    before = F.coalesce(F.sum("__n").over(mine.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__none", "__k", "__b", before.alias("__off"), F.sum("__n").over(mine).alias("class_n"))
    place = F.row_number().over(Window.partitionBy("__none", "__k", "__b").orderBy("__h", "__key"))
    out = d.withColumn("__at", place).join(sizes, ["__none", "__k", "__b"])
    return out.select(*[c(x) for x in df.columns], (F.col("__off") + F.col("__at") - 1).alias("class_row"), "class_n")


def stratified_split(df: DataFrame, key: Sequence[str], target: str, test_pct: int = TEST_PCT) -> DataFrame:
    """G1, stratified: ``is_test`` for the first round(n · test_pct / 100) rows of each class by key hash."""
    r = class_ranks(df, key, target)
    return r.withColumn("is_test", F.col("class_row") < F.floor((F.col("class_n") * test_pct + 50) / 100)).drop("class_row", "class_n")


def stratified_folds(df: DataFrame, key: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """H2, stratified: ``fold`` 0 to k − 1, each with its share of every class to one row."""
    r = class_ranks(df, key, target)
    return r.withColumn("fold", F.floor(F.col("class_row") * k / F.col("class_n")).cast("int")).drop("class_row", "class_n")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Class counts, minority/majority ratio and the primary metric it implies."""
    cnt = df.where(c(target).isNotNull()).groupBy(as_label(df, target).alias("class")).agg(F.count("*").alias("count"))
    mm = cnt.agg(F.min("count").alias("mn"), F.max("count").alias("mx")).first()
    ratio = F.lit(float(mm["mn"]) / float(mm["mx"])) if mm["mx"] else F.lit(None).cast("double")
    return cnt.select("class", "count", r4(ratio).alias("ratio"),
                    F.when(ratio < IMBALANCE_METRIC_RATIO, "f1_weighted").otherwise("accuracy").alias("metric"))


def model_context(n_rows: int, n_features: int, n_significant: int, problem_type: str) -> dict:
    """High-dimensional flag and counts that steer the candidate list."""
    if problem_type == "classification":
        high = n_features > max(30, 0.35 * n_rows)
    else:
        high = n_features > max(25, 0.25 * n_rows)
    return {"n_rows": n_rows, "n_features": n_features, "n_significant": n_significant, "high_dimensional": high}


def balanced_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Row weight n / (k · n_class), as ``class_weight='balanced'``; classes table is broadcast."""
    lab = as_label(df, target)
    cnt = df.where(c(target).isNotNull()).groupBy(lab.alias("__cls")).agg(F.count("*").alias("__nc"))
    agg = cnt.agg(F.sum("__nc").alias("n"), F.count("*").alias("k")).first()
    w = cnt.select("__cls", (F.lit(float(agg["n"])) / (F.lit(float(agg["k"])) * F.col("__nc"))).alias(out))
    return df.withColumn("__cls", lab).join(bounded_broadcast(w, int(agg["k"])), "__cls", "left").drop("__cls")


def dummy_classifier(train: DataFrame, target: str):
    """The most frequent training class (smallest on ties)."""
    from tabprobe.operators.features import modes
    return modes(train, [target])[target]


def dummy_regressor(train: DataFrame, target: str) -> float:
    """The training mean."""
    return train.agg(F.avg(as_double(train, target))).first()[0]


# ── metrics ───────────────────────────────────────────────────────────────────

def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")) \
        .agg(F.count("*").alias("count"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 (0 on zero division) and support."""
    cc = confusion_counts(pred, label, prediction)
    tp = cc.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("class"), F.col("count").alias("tp"))
    sup = cc.groupBy(F.col("label").alias("class")).agg(F.sum("count").alias("support"))
    pp = cc.groupBy(F.col("prediction").alias("class")).agg(F.sum("count").alias("predicted"))
    j = sup.join(pp, "class", "full").join(tp, "class", "left").fillna(0, ["tp", "support", "predicted"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return j.select("class", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), F.col("support").cast("long").alias("support"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1, both from one count of (label, prediction): rows are predicted once."""
    cc = confusion_counts(pred, label, prediction).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        side = lambda x, out: cc.select(F.col(x).alias("class"), *[(F.col("count") if o == out else F.lit(0)).alias(o)
                                                                   for o in ("tp", "support", "predicted")])
        hits = cc.where(F.col("label") == F.col("prediction"))
        tp = hits.select(F.col("label").alias("class"), F.col("count").alias("tp"), F.lit(0).alias("support"), F.lit(0).alias("predicted"))
        rep = side("label", "support").unionByName(side("prediction", "predicted")).unionByName(tp)
        rep = rep.groupBy("class").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "predicted")])
        # precision and recall are tp / predicted and tp / support
        f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
        m = rep.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted")).first()
    finally:
        cc.unpersist()
    return pred.sparkSession.createDataFrame([(m["accuracy"], m["f1_weighted"])], "accuracy double, f1_weighted double")


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R², MAE, RMSE in one aggregation."""
    y, yh = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - yh
    a = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("vy"))
    r2 = F.when(F.col("vy") > 0, 1 - F.col("mse") / F.col("vy")).otherwise(F.lit(0.0))
    return a.select(r2.alias("r2"), F.col("mae"), F.sqrt("mse").alias("rmse"))


def needs_tuning(score: float, metric: str) -> bool:
    """Tuning is skipped when the baseline is already good enough."""
    return not score > GOOD_ENOUGH.get(metric, 1.0)


def residual_table(pred: DataFrame, key: str, label: str = "label", prediction: str = "prediction",
                   n: int | None = None) -> DataFrame:
    """Actual, predicted, residual of every row; of a stable sample of ``n`` rows where ``n`` is given."""
    from tabprobe.operators.eda import stable_sample
    s = pred if n is None else stable_sample(pred, key, n)
    return s.select(key, F.col(label).cast("double").alias("actual"), F.col(prediction).cast("double").alias("predicted"),
                    (F.col(label).cast("double") - F.col(prediction).cast("double")).alias("residual"))


# ── estimators ────────────────────────────────────────────────────────────────

def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    plain = [f"__f{i}" for i in range(len(features))]  # the assembler can't read names with dots
    d = df.withColumns({p: c(x) for p, x in zip(plain, features, strict=True)})
    return VectorAssembler(inputCols=plain, outputCol=out, handleInvalid="keep").transform(d).drop(*plain)


def label_index(train: DataFrame, target: str) -> list[str]:
    """Sorted class labels → index (the label column Spark ML classifiers need)."""
    return [r["v"] for r in train.select(as_label(train, target).alias("v")).where(F.col("v").isNotNull())
            .distinct().orderBy("v").collect()]


def with_label(df: DataFrame, target: str, classes: Sequence[str] | None) -> DataFrame:
    if classes is None:
        return df.withColumn("label", as_double(df, target))
    idx = F.lit(None).cast("double")
    lab = as_label(df, target)
    for i, k in enumerate(classes):
        idx = F.when(lab == k, F.lit(float(i))).otherwise(idx) if i else F.when(lab == k, F.lit(0.0))
    return df.withColumn("label", idx)


def classifier_candidates(n_train: int, high_dim: bool, n_significant: int) -> dict:
    """The most frequent class, logistic regression, ridge classifier (least squares on ±1, one-vs-rest), a small tree."""
    # penalty 1 / (C·n) with C = 1
    c = {"dummy": "dummy", "logistic_regression": LogisticRegression(maxIter=200, regParam=1.0 / max(n_train, 1), standardization=False),
         "ridge_classifier": "ridge_ovr",
         "decision_tree": DecisionTreeClassifier(maxDepth=TREE_DEPTH, minInstancesPerNode=TREE_LEAF, seed=42)}
    if high_dim and n_significant >= 8:
        c.pop("decision_tree")
    return c


def regressor_candidates(n_train: int, high_dim: bool) -> dict:
    """The mean, linear, ridge (α/n), lasso, small tree (if not high-dimensional)."""
    c = {"dummy": "dummy", "linear_regression": LinearRegression(regParam=0.0),
         "ridge": LinearRegression(regParam=RIDGE_ALPHA / max(n_train, 1), elasticNetParam=0.0, standardization=False),
         "lasso": LinearRegression(regParam=LASSO_ALPHA, elasticNetParam=1.0, standardization=False)}
    if not high_dim:
        c["decision_tree"] = DecisionTreeRegressor(maxDepth=TREE_DEPTH, minInstancesPerNode=TREE_LEAF, seed=42)
    return c


def _ridge_ovr_fit(train: DataFrame, k: int, alpha: float, weight: str | None):
    models = []
    n = max(train.count(), 1)
    for i in range(k if k > 2 else 1):
        d = train.withColumn("__y", F.when(F.col("label") == float(i if k > 2 else 1), 1.0).otherwise(-1.0))
        lr = LinearRegression(featuresCol="features", labelCol="__y", regParam=alpha / n, elasticNetParam=0.0,
                              standardization=False)
        if weight:
            lr = lr.setWeightCol(weight)
        models.append(lr.fit(d))
    return models


def _ridge_ovr_predict(models, df: DataFrame, k: int) -> DataFrame:
    out = df
    for i, m in enumerate(models):
        out = m.setPredictionCol(f"__s{i}").transform(out)
    if k <= 2:
        return out.withColumn("prediction", F.when(F.col("__s0") > 0, 1.0).otherwise(0.0)).drop("__s0")
    scores = F.array(*[F.struct(F.col(f"__s{i}").alias("s"), F.lit(float(i)).alias("i")) for i in range(len(models))])
    return out.withColumn("prediction", F.array_max(scores)["i"]).drop(*[f"__s{i}" for i in range(len(models))])


def fit_predict(est, train: DataFrame, test: DataFrame, k: int | None = None, weight: str | None = None) -> DataFrame:
    """Fit one candidate on ``train`` (assembled), return ``test`` with a ``prediction`` column."""
    if est == "dummy":
        known = train.where(F.col("label").isNotNull())
        if k:
            best = known.groupBy("label").count().orderBy(F.desc("count"), "label").first()
            return test.withColumn("prediction", F.lit(best["label"] if best else None).cast("double"))
        return test.withColumn("prediction", F.lit(known.agg(F.avg("label")).first()[0]).cast("double"))
    if est == "ridge_ovr":
        models = _ridge_ovr_fit(train, k or 2, RIDGE_ALPHA, weight)
        return _ridge_ovr_predict(models, test, k or 2)
    e = est.copy()
    if weight and e.hasParam("weightCol"):
        e = e.setWeightCol(weight)
    return e.fit(train).transform(test)


def score(pred: DataFrame, problem_type: str, metric: str) -> float:
    if problem_type == "classification":
        m = classification_metrics(pred).first()
        return float(m[metric])
    return float(regression_metrics(pred).first()["r2"])


def baseline_leaderboard(prepared: DataFrame, features: Sequence[str], target: str, problem_type: str,
                         split_col: str = "is_test", n_significant: int = 0) -> tuple[DataFrame, dict]:
    """Fit every candidate (unweighted and, when imbalanced, balanced) and score the holdout.

    Returns (leaderboard DataFrame, summary dict with winner, metric, strategy and score).
    """
    spark = prepared.sparkSession
    classes = label_index(prepared.where(~F.col(split_col)), target) if problem_type == "classification" else None
    d = assemble(with_label(prepared, target, classes), features).select("features", "label", split_col, c(target))
    d = d.persist(StorageLevel.MEMORY_AND_DISK)  # every candidate reads it
    train, test = d.where(~F.col(split_col)), d.where(F.col(split_col))
    n_train = train.count()
    ctx = model_context(n_train, len(features), n_significant, problem_type)
    metric, strategies = "r2", ["unweighted"]
    if problem_type == "classification":
        bal = class_balance(train, target).first()
        metric = bal["metric"]
        if bal["ratio"] < IMBALANCE_METRIC_RATIO:
            strategies.append("balanced")
            train = balanced_weights(train, target)
        cands = classifier_candidates(n_train, ctx["high_dimensional"], n_significant)
    else:
        cands = regressor_candidates(n_train, ctx["high_dimensional"])
    rows = []
    pos = 0
    for strat in strategies:
        for name, est in cands.items():
            try:
                pred = fit_predict(est, train, test, len(classes) if classes else None,
                                   "weight" if strat == "balanced" else None)
                s = score(pred, problem_type, metric)
                rows.append((name, strat, pos, metric, round(s, 4), None))
            except Exception as e:  # noqa: BLE001 — a failing candidate is logged and skipped
                rows.append((name, strat, pos, metric, None, str(e)[:200]))
            pos += 1
    d.unpersist()
    lb = spark.createDataFrame(rows, "model string, strategy string, position int, metric string, score double, error string")
    best = max((r for r in rows if r[4] is not None), key=lambda r: (r[4], -r[2]), default=None)
    summary = {"metric": metric, "best_model": best[0] if best else None, "strategy": best[1] if best else None,
               "score": best[4] if best else None, "needs_tuning": needs_tuning(best[4], metric) if best else True,
               "context": ctx}
    return lb, summary


def refit_and_predict(prepared: DataFrame, rows: DataFrame, features: Sequence[str], target: str, problem_type: str, summary: dict,
                      n_significant: int = 0) -> DataFrame:
    """The leaderboard's winner refitted on all of ``prepared``; ``rows`` with ``prediction`` (a class label, or a number).

    ``summary`` is what ``baseline_leaderboard`` returns: it names the winner and whether its rows are weighted.
    """
    classes = label_index(prepared, target) if problem_type == "classification" else None
    train, new = (assemble(with_label(d, target, classes), features) for d in (prepared, rows))
    n = train.count()
    ctx = model_context(n, len(features), n_significant, problem_type)
    if classes is None:
        return fit_predict(regressor_candidates(n, ctx["high_dimensional"])[summary["best_model"]], train, new).drop("features", "label")
    weight = "weight" if summary["strategy"] == "balanced" else None
    train = balanced_weights(train, target) if weight else train
    cands = {**classifier_candidates(n, False, 0)}
    pred = fit_predict(cands[summary["best_model"]], train, new, len(classes), weight)
    name = F.element_at(F.array(*[F.lit(x) for x in classes]), F.col("prediction").cast("int") + 1)
    return pred.withColumn("prediction", name).drop("features", "label", "rawPrediction", "probability")


def imbalance_comparison(leaderboard: DataFrame) -> DataFrame:
    """Best unweighted vs best balanced score and the chosen strategy."""
    b = leaderboard.where(F.col("score").isNotNull()).groupBy("strategy").agg(
        F.max_by(F.struct("model", "score"), F.struct("score", -F.col("position"))).alias("best"))
    best = {r["strategy"]: r["best"] for r in b.collect()}  # at most two rows
    u, w = best.get("unweighted"), best.get("balanced")
    j = leaderboard.sparkSession.createDataFrame(
        [(u["model"] if u else None, u["score"] if u else None, w["model"] if w else None, w["score"] if w else None)],
        "best_unweighted string, unweighted_score double, best_balanced string, balanced_score double")
    return j.withColumn("delta", F.col("balanced_score") - F.col("unweighted_score")).withColumn(
        "chosen", F.when(F.col("delta") > 0, "balanced").otherwise("unweighted"))


def feature_importance(model, features: Sequence[str], spark, top: int = 20) -> DataFrame:
    """Tree importances, or mean |coefficient| across classes, top ``top`` by size."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficientMatrix"):
        m = model.coefficientMatrix.toArray()
        vals = [float(abs(m[:, j]).mean()) for j in range(m.shape[1])]
    else:
        vals = [abs(float(v)) for v in model.coefficients.toArray()]
    rows = sorted(zip(features, vals), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")
