"""The append-only run log: parents, children, status, start time, and what is reused from it."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tabprobe.operators import tuning as H

TRIALS = "model_id string, strategy string, trial_index int, cv_score double, holdout_score double, params map<string,string>"


def test_log_and_reuse(spark, tmp_path):
    path = str(tmp_path / "log")
    day = lambda d: datetime(2026, 1, d, tzinfo=UTC)
    runs = {"b_old": (0.7, "finished", 1), "a_new": (0.7, "finished", 5), "failed": (0.9, "failed", 9), "weak": (0.5, "finished", 8)}
    for run, (score, status, d) in runs.items():
        t = spark.createDataFrame([("ridge", "unweighted", 0, score - 0.1, 0.4, {"alpha": "2"}), ("ridge", "unweighted", 1, score, 0.6, {"alpha": "0.5"}),
                                   ("tree", "unweighted", 0, score - 0.2, 0.5, {"max_depth": "6", "kind": "gini"})], TRIALS)
        H.log_trials(t, path, run, parent_id=f"search-{run}", status=status, started=day(d), tags={"by": "test"})
        H.log_parent(t, path, f"search-{run}", status=status, started=day(d))
    logged = spark.read.parquet(path)
    assert logged.count() == 4 * (3 + 1)
    parents = {r.run_id: r for r in logged.where("run_type = 'parent'").collect()}
    assert parents["search-failed"].status == "failed" and parents["search-weak"].cv_score == 0.5 and parents["search-weak"].holdout_score == 0.6
    child = logged.where("run_type = 'child' AND run_id = 'weak'").first()
    assert child.parent_id == "search-weak" and child.tags == {"by": "test"} and child.started is not None
    long = logged.where("run_type = 'child'").select("run_id", "status", "started", "model_id", "trial_index", "cv_score",
                                                     F.explode("params").alias("param_name", "param_value"))
    got = {(r.run_id, r.model_id, r.trial_index, r.param_name, r.typed.as_int, r.typed.as_double, r.typed.as_string) for r in H.reuse_best_params(long).collect()}
    assert got == {("a_new", "ridge", 1, "alpha", None, 0.5, None), ("a_new", "tree", 0, "max_depth", 6, None, None), ("a_new", "tree", 0, "kind", None, None, "gini")}


def test_report_and_gain(spark):
    t = spark.createDataFrame([("a", "unweighted", 0, 0.6, 0.55, {}), ("a", "unweighted", 1, 0.7, 0.65, {}), ("b", "unweighted", 0, 0.4, 0.5, {}), ("c", "unweighted", 0, None, None, {})], TRIALS)
    got = {r.model_id: (r.cv_score, r.winner, r.winner_cv, r.winner_holdout) for r in H.tuning_report(t).collect()}
    assert got == {"a": (0.7, "a", 0.7, 0.65), "b": (0.4, "a", 0.7, 0.65)}
    assert abs(H.gain_over_baseline(t, {"metric": "accuracy", "score": 0.6}).first()["gain"] - 0.05) < 1e-12
    assert H.gain_over_baseline(t.limit(0), {"metric": "accuracy", "score": 0.6}).first()["gain"] is None
