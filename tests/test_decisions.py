"""Preparation decisions as tables, against hand-worked rows."""

import math

from tabprobe.operators import features as X
from tabprobe.plans import decisions as D
from tabprobe.plans.signals import measured_signals

PROFILE = ("column string, semantic_type string, missing_pct double, iqr_outlier_pct double, skewness double, negatives_count long,"
           " cardinality_ratio double")
SIGNALS = "feature string, significant_after_fdr boolean, effect_label string, effect_size double, abs_r double, mi_score double"


def facts(spark, profile=(), signals=(), plan=None, sources=(), names="abcdefgh"):
    prof = spark.createDataFrame(list(profile), PROFILE)
    sig = spark.createDataFrame(list(signals), SIGNALS)
    return D.column_facts(spark, names, prof, sig, plan or {}, sources)


def test_drops(spark):
    f = facts(spark,
              [("a", "id", 0.0, 0.0, 0.0, 0, 1.0), ("b", "constant", 0.0, None, None, None, None), ("c", "numeric", 80.0, None, None, None, None),
               ("d", "numeric", 41.0, None, None, None, None), ("e", "numeric", 41.0, None, None, None, None), ("f", "numeric", 40.0, None, None, None, None),
               ("g", "id", 99.0, None, None, None, None)],
              [("b", True, "small", 0.0, 0.0, 0.0), ("e", False, "small", 0.0, 0.15, 0.0)],
              {"h": {"action": "drop"}}, sources=["g", "h"])
    assert [tuple(r) for r in D.drop_decisions(f).collect()] == [
        ("a", "constant_or_id", False), ("c", "mostly_missing", False), ("d", "high_missing_no_signal", False), ("h", "plan", True)]


def test_transforms(spark):
    plan = {"a": {"action": "transform", "method": "sqrt"}, "b": {"action": "transform", "method": "sqrt"},
            "c": {"action": "keep", "method": "sqrt"}, "d": {"action": "transform", "method": "winsorize"}}
    f = facts(spark, [("a", "numeric", 0.0, 9.0, 3.0, 0, 1.0), ("b", "numeric", 0.0, 9.0, 3.0, 2, 1.0), ("c", "numeric", 0.0, 5.0, -1.5, 0, 1.0),
                      ("d", "numeric", 0.0, 9.0, 1.0, 0, 1.0), ("e", "numeric", 0.0, None, None, None, None)], plan=plan)
    assert {r["column"] for r in D.needs_bounds(f).collect()} == {"a", "b", "d"}
    ranges = spark.createDataFrame([("a", 0.0, True), ("b", -2.0, True), ("c", 0.0, False), ("d", 1.0, False), ("e", None, False)],
                                   "column string, low double, has_bounds boolean")
    assert [tuple(r) for r in D.transform_decisions(f, ranges).collect()] == [
        ("a", "sqrt", "plan"), ("b", "winsorize", "rule"), ("b", "yeo_johnson", "rule"), ("c", "log1p", "rule")]


def test_low_signal_needs_a_significant_column(spark):
    weak = [("a", False, "negligible", 0.09, 0.04, 0.01), ("b", False, "negligible", 0.1, 0.04, 0.01), ("c", False, "large", 0.0, 0.0, 0.0)]
    assert D.low_signal_decisions(facts(spark, signals=weak)).count() == 0
    f = facts(spark, signals=[*weak, ("d", True, "small", 0.0, 0.0, 0.0)], plan={"f": {"action": "encode"}}, sources=["g"])
    assert [r[0] for r in D.low_signal_decisions(f, kept=["h"]).collect()] == ["a", "e"]
    left = D.facts_of(f, ["new", "a"])
    assert D.low_signal_decisions(left).count() == 0
    assert [r[0] for r in D.low_signal_decisions(left, ["new"], tested=f).collect()] == ["a"]


def test_collinear_pairs(spark):
    f = facts(spark, signals=[("a", False, "small", 0.2, 0.3, 0.0), ("b", False, "small", 0.3, 0.3, 0.0), ("c", True, "small", 0.0, 0.0, 0.0),
                              ("d", True, "large", 0.9, 0.9, 0.0)])
    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f"), ("b", "gone")], "col_a string, col_b string")
    # a has the smaller effect; c and d are significant and stay; e and f tie, so the second goes
    assert [r[0] for r in D.collinear_decisions(f, pairs).collect()] == ["a", "f"]
    assert D.collinear_decisions(f, pairs.limit(0)).count() == 0


def test_signals_not_measured_drop_nothing(spark):
    """A table of tests alone says nothing of mutual information or of r: no column goes for want of them."""
    tests = spark.createDataFrame([("a", True, "large", 0.9), ("b", False, "negligible", 0.01)],
                                  "feature string, significant_after_fdr boolean, effect_label string, effect_size double")
    prof = spark.createDataFrame([("b", "numeric", 41.0, None, None, None, None)], PROFILE)
    for signals in (tests, None):
        f = D.column_facts(spark, "ab", prof, signals, {})
        assert D.drop_decisions(f).count() == 0 and D.low_signal_decisions(f).count() == 0


def test_all_signals_reach_the_rules(spark):
    """A feature known by its mutual information only stays, its near copy goes as collinear."""
    def row(i):
        v, ring, noise = i * 7919 % 2000 / 100, i * 104729 % 2001 / 1000 - 1, i * 15485863 % 1999 / 100
        y = v + 12 * math.cos(2 * math.pi * ring)
        level = f"l{i * 7919 % 2000 // 100}"
        return i, v, ring, 2 * ring + i % 2 / 1000, noise, level, y

    train = spark.createDataFrame([row(i) for i in range(2000)],
                                  "id long, v double, ring double, twin double, noise double, level string, y double")
    signals, pairs = measured_signals(train, "y", ["id"], "regression")
    got = {r["feature"]: r for r in signals.collect()}
    assert got["ring"]["mi_score"] > 0.2 and got["ring"]["abs_r"] < 0.05 and not got["ring"]["significant_after_fdr"]
    assert got["level"]["target_encoding"] and pairs == [("ring", "twin")]
    model = X.fit(train, "y", ["id"], signals=signals, collinear_pairs=pairs)
    assert [(x, r) for x, a, _, r in model.steps if a == "drop"] in ([("twin", "collinear")], [("ring", "collinear")])
    assert len({"ring", "twin"} & set(model.columns)) == 1
