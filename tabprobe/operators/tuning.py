"""Hyper-parameter search and the trial log.

Search spaces keep the reference's ranges; draws are seeded random search (the
reference's smoke mode is itself a random sampler). Each trial fits Spark ML
estimators on cached fold frames; the trial records become a ``trials``
DataFrame, and the best-per-model / reuse queries are window / max_by queries
over that table.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.keyhash import fold_of, row_key
from tabprobe.operators import models as M
from tabprobe.operators.naive_bayes import GaussianNB

# ── fixed search spaces (ranges as the reference defines them) ────────────────
# ("cat", choices) | ("int", low, high, step) | ("float", low, high, log)
SPACES = {
    "logistic_regression": {"C": ("float", 1e-3, 50, True)},
    "ridge_classifier": {"alpha": ("float", 1e-3, 20, True)},
    "linear_svc": {"C": ("float", 1e-3, 20, True)},
    "gaussian_nb": {"var_smoothing": ("float", 1e-11, 1e-6, True)},
    "decision_tree_classifier": {"max_depth": ("cat", [None, 4, 6, 8, 12, 16]), "min_samples_leaf": ("int", 1, 12, 1)},
    "random_forest_classifier": {"n_estimators": ("int", 150, 500, 50), "max_depth": ("cat", [None, 8, 12, 16, 24]),
                                 "min_samples_leaf": ("int", 1, 8, 1), "max_features": ("cat", ["sqrt", "log2", None])},
    "gradient_boosting_classifier": {"n_estimators": ("int", 50, 300, 25), "learning_rate": ("float", 0.01, 0.3, True),
                                     "max_depth": ("int", 2, 5, 1), "subsample": ("float", 0.6, 1.0, False)},
    "hist_gradient_boosting_classifier": {"learning_rate": ("float", 0.01, 0.3, True),
                                          "max_depth": ("cat", [None, 4, 6, 8, 12]),
                                          "max_leaf_nodes": ("int", 15, 127, 8), "min_samples_leaf": ("int", 10, 50, 5)},
    "bagging_classifier": {"n_estimators": ("int", 10, 100, 10), "max_samples": ("float", 0.5, 1.0, False),
                           "max_features": ("float", 0.5, 1.0, False)},
    "ada_boost_classifier": {"n_estimators": ("int", 25, 250, 25), "learning_rate": ("float", 0.01, 2, True)},
    "mlp_classifier": {"hidden_layer_sizes": ("cat", [(64,), (128,), (256,), (64, 32), (128, 64)]),
                       "alpha": ("float", 1e-6, 0.1, True), "learning_rate_init": ("float", 1e-4, 0.05, True)},
    "decision_tree_regressor": {"max_depth": ("cat", [None, 4, 6, 8, 12, 16]), "min_samples_leaf": ("int", 1, 12, 1)},
    "random_forest_regressor": {"n_estimators": ("int", 150, 500, 50), "max_depth": ("cat", [None, 8, 12, 16, 24]),
                                "min_samples_leaf": ("int", 1, 8, 1), "max_features": ("cat", ["sqrt", "log2", None])},
    "gradient_boosting_regressor": {"n_estimators": ("int", 50, 300, 25), "learning_rate": ("float", 0.01, 0.3, True),
                                    "max_depth": ("int", 2, 5, 1), "subsample": ("float", 0.6, 1.0, False)},
    "hist_gradient_boosting_regressor": {"learning_rate": ("float", 0.01, 0.3, True),
                                         "max_depth": ("cat", [None, 4, 6, 8, 12]),
                                         "max_leaf_nodes": ("int", 15, 127, 8), "min_samples_leaf": ("int", 10, 50, 5)},
    "bagging_regressor": {"n_estimators": ("int", 10, 100, 10), "max_samples": ("float", 0.5, 1.0, False),
                          "max_features": ("float", 0.5, 1.0, False)},
    "linear_regression": {"fit_intercept": ("cat", [True, False])},
    "ridge_regressor": {"alpha": ("float", 1e-4, 50, True)},
    "lasso_regressor": {"alpha": ("float", 1e-6, 1, True)},
    "elasticnet_regressor": {"alpha": ("float", 1e-6, 1, True), "l1_ratio": ("float", 0.05, 0.95, False)},
}
WEIGHTED = {"logistic_regression", "ridge_classifier", "linear_svc", "decision_tree_classifier", "random_forest_classifier"}
DEFAULT_TRIALS, SMOKE_TRIALS, CV_FOLDS = 12, 1, 3
SPARK_MAX_DEPTH = 30


def default_families(problem_type: str) -> list[str]:
    return [f for f in SPACES if f.endswith("_classifier") or f in ("logistic_regression", "gaussian_nb", "linear_svc")] \
        if problem_type == "classification" else [f for f in SPACES if f.endswith("_regressor") or f == "linear_regression"]


def resolve_candidates(requested: Sequence[str] | None, problem_type: str) -> list[str]:
    """H5: requested ∩ registry, else every default family of the problem type."""
    allowed = default_families(problem_type)
    got = [f for f in (requested or []) if f in allowed]
    return got or allowed


def balance_strategies(family: str, ratio: float | None) -> list[str]:
    """H6: unweighted, plus balanced where the family takes weights and classes are imbalanced."""
    out = ["unweighted"]
    if ratio is not None and ratio < M.IMBALANCE_METRIC_RATIO and family in WEIGHTED:
        out.append("balanced")
    return out


def tuning_trials(mode: str, planned: int | None = None) -> int:
    """H7: smoke_test → 1 trial per family, full_search → the planned count (default 12)."""
    return SMOKE_TRIALS if mode == "smoke_test" else (planned or DEFAULT_TRIALS)


def sample_params(family: str, rng: random.Random) -> dict:
    """H1: one seeded draw from the family's space."""
    out = {}
    for name, spec in SPACES[family].items():
        if spec[0] == "cat":
            out[name] = rng.choice(spec[1])
        elif spec[0] == "int":
            lo, hi, step = spec[1:]
            out[name] = lo + step * rng.randrange(0, (hi - lo) // step + 1)
        else:
            lo, hi, log = spec[1:]
            out[name] = math.exp(rng.uniform(math.log(lo), math.log(hi))) if log else rng.uniform(lo, hi)
    return out


def build_estimator(family: str, p: dict, n_train: int, k: int):
    """Spark ML estimator for a family and parameter draw (conversions derived from the objectives)."""
    depth = lambda d: SPARK_MAX_DEPTH if d is None else int(d)
    subset = {"sqrt": "sqrt", "log2": "log2", None: "all"}
    if family == "logistic_regression":
        return LogisticRegression(regParam=1.0 / (p["C"] * max(n_train, 1)), maxIter=200, standardization=False)
    if family == "ridge_classifier":
        return ("ridge_ovr", p["alpha"])
    if family == "linear_svc":
        svc = LinearSVC(regParam=1.0 / (p["C"] * max(n_train, 1)), maxIter=100, standardization=False)
        return OneVsRest(classifier=svc) if k > 2 else svc
    if family == "gaussian_nb":
        return GaussianNB(var_smoothing=p["var_smoothing"])
    if family.startswith("decision_tree"):
        cls = DecisionTreeClassifier if family.endswith("classifier") else DecisionTreeRegressor
        return cls(maxDepth=min(depth(p["max_depth"]), SPARK_MAX_DEPTH), minInstancesPerNode=int(p["min_samples_leaf"]), seed=42)
    if family.startswith("random_forest"):
        cls = RandomForestClassifier if family.endswith("classifier") else RandomForestRegressor
        return cls(numTrees=int(p["n_estimators"]), maxDepth=min(depth(p["max_depth"]), SPARK_MAX_DEPTH),
                   minInstancesPerNode=int(p["min_samples_leaf"]), featureSubsetStrategy=subset[p["max_features"]], seed=42)
    if family.startswith("bagging"):
        cls = RandomForestClassifier if family.endswith("classifier") else RandomForestRegressor
        return cls(numTrees=int(p["n_estimators"]), featureSubsetStrategy=str(round(p["max_features"], 4)),
                   subsamplingRate=p["max_samples"], bootstrap=True, maxDepth=SPARK_MAX_DEPTH, seed=42)
    if family.startswith("gradient_boosting") or family.startswith("hist_gradient_boosting"):
        cls = GBTClassifier if family.endswith("classifier") else GBTRegressor
        d = p.get("max_depth")
        if family.startswith("hist") and d is None:
            d = math.ceil(math.log2(p["max_leaf_nodes"]))
        kw = dict(maxIter=int(p.get("n_estimators", 100)), stepSize=p["learning_rate"], maxDepth=int(d),
                  subsamplingRate=p.get("subsample", 1.0), seed=42)
        if "min_samples_leaf" in p:
            kw["minInstancesPerNode"] = int(p["min_samples_leaf"])
        est = cls(**kw)
        return OneVsRest(classifier=est) if family.endswith("classifier") and k > 2 else est
    if family == "mlp_classifier":
        return ("mlp", p)
    if family == "ada_boost_classifier":
        return ("ada", p)
    if family == "linear_regression":
        return LinearRegression(fitIntercept=bool(p["fit_intercept"]), regParam=0.0)
    if family == "ridge_regressor":
        return LinearRegression(regParam=p["alpha"] / max(n_train, 1), elasticNetParam=0.0, standardization=False)
    if family == "lasso_regressor":
        return LinearRegression(regParam=p["alpha"], elasticNetParam=1.0, standardization=False)
    if family == "elasticnet_regressor":
        return LinearRegression(regParam=p["alpha"], elasticNetParam=p["l1_ratio"], standardization=False)
    raise ValueError(f"unknown family {family}")


def _fit_predict(est, train: DataFrame, test: DataFrame, k: int, n_features: int, weight: str | None) -> DataFrame:
    if isinstance(est, tuple) and est[0] == "ridge_ovr":
        models = M._ridge_ovr_fit(train, k, est[1], weight)
        return M._ridge_ovr_predict(models, test, k)
    if isinstance(est, tuple) and est[0] == "ada":
        from tabprobe.operators.boosting import ada_boost_fit
        model = ada_boost_fit(train, k, int(est[1]["n_estimators"]), est[1]["learning_rate"], weight)
        return model.transform(test)
    if isinstance(est, tuple) and est[0] == "mlp":
        p = est[1]
        layers = [n_features, *p["hidden_layer_sizes"], k]
        est = MultilayerPerceptronClassifier(layers=layers, stepSize=p["learning_rate_init"], solver="gd",
                                             maxIter=100, seed=42)
    if isinstance(est, GaussianNB):
        return GaussianNB(est.var_smoothing, weight=weight).fit(train).transform(test)
    if weight and est.hasParam("weightCol"):
        est = est.copy().setWeightCol(weight)
    return est.fit(train).transform(test)


def cv_folds(df: DataFrame, key: Sequence[str], k: int = CV_FOLDS) -> DataFrame:
    """H2: fold column from the key hash (0..k−1)."""
    return df.withColumn("fold", fold_of(row_key(key), k))


def run_trials(prepared: DataFrame, features: Sequence[str], target: str, key: Sequence[str], problem_type: str,
               families: Sequence[str] | None = None, mode: str = "smoke_test", trials: int | None = None,
               k: int = CV_FOLDS, seed: int = 42, parallelism: int = 2) -> DataFrame:
    """H3: family × strategy × trial → mean CV score and holdout score; failures are logged, not raised.

    ``prepared`` holds the prepared features and ``is_test``. Fold frames are
    cached once; folds hold their share of each class; fits run from a small driver thread pool, as CrossValidator does.
    """
    spark = prepared.sparkSession
    classes = M.label_index(prepared.where(~F.col("is_test")), target) if problem_type == "classification" else None
    kk = len(classes) if classes else 1
    folded = cv_folds(prepared, key, k)
    if classes:  # folds of training rows hold their share of each class
        held = prepared.where(F.col("is_test")).withColumn("fold", F.lit(0))
        folded = M.stratified_folds(prepared.where(~F.col("is_test")), key, target, k).unionByName(held)
    d = M.assemble(M.with_label(folded, target, classes), features).select(
        "features", "label", "fold", "is_test", *([target] if problem_type == "classification" else []))
    unweighted = d.where(~F.col("is_test")).cache()
    test = d.where(F.col("is_test"))
    n_train = unweighted.count()
    train_all = M.spread(unweighted, n_train)
    metric, ratio = "r2", None
    if problem_type == "classification":
        bal = M.class_balance(unweighted, target).first()
        metric, ratio = bal["metric"], bal["ratio"]
        train_all = M.balanced_weights(train_all, target)
    train_all = train_all.cache()
    fams = resolve_candidates(families, problem_type)
    n_trials = tuning_trials(mode, trials)
    jobs = []
    for fam in fams:
        rng = random.Random(f"{seed}:{fam}")
        for t in range(n_trials):
            p = sample_params(fam, rng)
            for strat in balance_strategies(fam, ratio):
                jobs.append((fam, strat, t, p))

    def run(job):
        fam, strat, t, p = job
        w = "weight" if strat == "balanced" else None
        try:
            est = build_estimator(fam, p, n_train, kk)
            cv = []
            for f in range(k):
                tr, va = train_all.where(F.col("fold") != f), train_all.where(F.col("fold") == f)
                cv.append(M.score(_fit_predict(est, tr, va, kk, len(features), w), problem_type, metric))
            hold = M.score(_fit_predict(est, train_all, test, kk, len(features), w), problem_type, metric)
            return (fam, strat, t, metric, float(sum(cv) / len(cv)), float(hold), {k_: str(v) for k_, v in p.items()}, None)
        except Exception as e:  # noqa: BLE001 — a failing trial is logged and skipped
            return (fam, strat, t, metric, None, None, {k_: str(v) for k_, v in p.items()}, str(e)[:300])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(run, jobs))
    train_all.unpersist()
    unweighted.unpersist()
    return spark.createDataFrame(rows, "model_id string, strategy string, trial_index int, metric string, "
                                       "cv_score double, holdout_score double, params map<string,string>, error string")


def best_per_model(trials: DataFrame) -> DataFrame:
    """H4: the highest-CV trial per model; the first (lowest run, trial) wins ties."""
    order = [F.col("cv_score").desc()] + [F.col(x) for x in ("run_id", "strategy", "trial_index") if x in trials.columns]
    w = Window.partitionBy("model_id").orderBy(*order)
    return trials.where(F.col("cv_score").isNotNull()).withColumn("__r", F.row_number().over(w)).where(
        F.col("__r") == 1).drop("__r")


def best_overall(trials: DataFrame) -> DataFrame:
    order = [F.col("cv_score").desc()] + [F.col(x) for x in ("run_id", "model_id", "strategy", "trial_index") if x in trials.columns]
    return trials.where(F.col("cv_score").isNotNull()).orderBy(*order).limit(1)


def tuning_report(trials: DataFrame) -> DataFrame:
    """H8: the best trial of each family, with the winner over all and its CV and holdout scores beside it."""
    b = best_overall(trials).first()
    return best_per_model(trials).withColumns({
        "winner": F.lit(b["model_id"] if b else None).cast("string"),
        "winner_cv": F.lit(b["cv_score"] if b else None).cast("double"),
        "winner_holdout": F.lit(b["holdout_score"] if b else None).cast("double")})


def gain_over_baseline(trials: DataFrame, summary: dict) -> DataFrame:
    """The tuned winner's holdout score less the best baseline's; NULL where either has none."""
    best = best_overall(trials).first()
    tuned = best["holdout_score"] if best else None
    gain = None if tuned is None or summary["score"] is None else tuned - summary["score"]
    return trials.sparkSession.createDataFrame([(summary["metric"], summary["score"], tuned, gain)],
                                               "metric string, baseline double, tuned double, gain double")


def log_trials(trials: DataFrame, path: str, run_id: str, run_type: str = "child", parent_id: str | None = None,
               status: str = "finished", started: datetime | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """H9: append trial records of a run as parquet partitioned by run type; returns the table as read back.

    A record has its run's id, parent, status, start time (now, if none is given) and tags beside the trial's own columns.
    """
    tag_map = F.create_map(*[F.lit(x) for kv in (tags or {}).items() for x in kv]) if tags else F.create_map().cast("map<string,string>")
    at = F.lit(started or datetime.now(UTC)).cast("timestamp")
    (trials.withColumns({"run_id": F.lit(run_id), "parent_id": F.lit(parent_id).cast("string"), "status": F.lit(status), "started": at, "tags": tag_map,
                         "run_type": F.lit(run_type)})
     .write.mode("append").partitionBy("run_type").parquet(path))
    return trials.sparkSession.read.option("mergeSchema", "true").parquet(path)


def log_parent(trials: DataFrame, path: str, run_id: str, status: str = "finished", started: datetime | None = None,
               tags: dict[str, str] | None = None) -> DataFrame:
    """H9: one record for a whole search: its best trial's columns, next to the children that ``log_trials`` writes."""
    return log_trials(best_overall(trials), path, run_id, "parent", None, status, started, tags)


def typed_param(v: F.Column) -> F.Column:
    """Parameter text typed by try_cast: integer → double → string (as a tagged struct)."""
    return F.struct(v.try_cast("bigint").alias("as_int"),
                    F.when(v.try_cast("bigint").isNull(), v.try_cast("double")).alias("as_double"),
                    F.when(v.try_cast("double").isNull(), v).alias("as_string"))


def reuse_best_params(trials: DataFrame) -> DataFrame:
    """The best run (highest best CV, then newest start, then newest id) → its best trial per model → typed params.

    ``trials`` has run_id, model_id, trial_index, cv_score and long-form param_name / param_value; with ``status`` only
    finished runs count, with ``started`` the newer of equal runs wins.
    """
    if "status" in trials.columns:
        trials = trials.where(F.col("status") == "finished")
    begun = F.max("started") if "started" in trials.columns else F.lit(None)
    runs = trials.groupBy("run_id").agg(F.max("cv_score").alias("best_score"), begun.alias("begun"))
    top = runs.orderBy(F.col("best_score").desc(), F.col("begun").desc(), F.col("run_id").desc()).limit(1)
    t = trials.join(top.select("run_id"), "run_id", "left_semi")
    best = t.groupBy("model_id").agg(F.max_by(F.struct("trial_index", "cv_score"),
                                              F.struct("cv_score", -F.col("trial_index"))).alias("b"))
    sel = t.join(best, "model_id").where(F.col("trial_index") == F.col("b.trial_index"))
    return sel.select("run_id", "model_id", "trial_index", "cv_score", "param_name", "param_value",
                      typed_param(F.col("param_value")).alias("typed"))
