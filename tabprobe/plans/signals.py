"""The signals that the preparation rules (F3, F4, F15–F17) read, all measured on the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.operators import eda as D
from tabprobe.operators import stats as S
from tabprobe.operators.profile import _freeze, kinds


def measured_signals(train: DataFrame, target: str, key: Sequence[str], problem: str,
                     tests: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``X.fit``'s ``signals`` and ``collinear_pairs``: tests (E25), MI (E21), flags (E22), |r| (D11); pairs of D12, then E19.

    Features without a test, an MI or an r have NULL there. A class target that is not a number has no r with anything:
    |r| is 0 then, as in the reference, and effect size and mutual information decide. A row per feature.
    """
    kind = {x: k for x, k in kinds(train).items() if x not in {target, *key}}
    numeric, strings = ([x for x, k in kind.items() if k == wanted] for wanted in ("numeric", "string"))
    tests = S.test_features(train, target, problem) if tests is None else tests
    mi = S.mutual_information(train, numeric, strings, target, problem) if numeric or strings else None
    ranked = _freeze(S.rank_features(tests, mi).select("feature", "test", "statistic", "p_value", "significant_after_fdr",
                                                       "effect_label", "effect_size", "mi_score"))
    signals = ranked.join(S.fe_signals(ranked, strings).select("feature", "target_encoding"), "feature", "left")
    if kinds(train)[target] == "numeric" and numeric:
        signals = signals.join(D.target_correlations(train, numeric, target).select("feature", "abs_r"), "feature", "left")
    else:
        signals = signals.withColumn("abs_r", F.lit(0.0))
    pairs: list[tuple[str, str]] = []
    if len(numeric) > 1:
        for found in (D.collinear_pairs(train, numeric), S.spearman_collinearity(train, numeric)):
            pairs += [p for p in sorted((r["col_a"], r["col_b"]) for r in found.collect()) if p not in pairs]
    return _freeze(signals), pairs
