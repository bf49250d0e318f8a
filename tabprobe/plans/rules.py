"""Feature-engineering plans (F1, F2): rules from the profile, merged with a caller's plan.

A plan is ``{column: {"action": ..., "method": ..., "reason": ...}}`` plus
interaction specs ``[{"col_a", "col_b", "type"}]``. The rule plan is a projection
of the C8 recommendations; a user plan wins column by column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed vocabularies
ACTIONS = ("drop", "transform", "decompose", "encode", "keep")
METHODS = {"transform": ("log1p", "sqrt", "yeo_johnson", "winsorize", "bin_quantile"),
           "decompose": ("cyclical",), "encode": ("target_encode", "frequency", "one_hot"),
           "drop": (None,), "keep": (None,)}
INTERACTION_TYPES = ("ratio", "product", "difference")


def plan_from_profile(recs: DataFrame) -> DataFrame:
    """C8 recommendations → (column, action, method, reason); columns with no transform are omitted."""
    t = F.col("suggested_transform")
    action = (F.when(t == "drop", "drop").when(t == "cyclical", "decompose")
              .when(t.isin("log1p", "yeo_johnson", "winsorize"), "transform")
              .when(t == "target_encode", "encode"))
    method = F.when(t == "drop", F.lit(None).cast("string")).otherwise(t)
    return recs.where(t.isNotNull()).select("column", action.alias("action"), method.alias("method"), "reason")


def plan_dict(plan_df: DataFrame) -> dict:
    """Collect a plan table (one row per column) into the dict form ``fit`` takes."""
    return {r["column"]: {"action": r["action"], "method": r["method"], "reason": r["reason"]}
            for r in plan_df.collect()}


def normalise_plan(df: DataFrame, rules: dict, user: dict | None = None,
                   interactions: list | None = None) -> tuple[dict, list]:
    """fill defaults, validate against the schema and the vocabularies; the user plan wins."""
    cols = set(df.columns)
    merged = {k: dict(v) for k, v in rules.items()}
    for col, spec in (user or {}).items():
        if col not in cols:
            raise ValueError(f"plan names unknown column {col!r}; available: {sorted(cols)}")
        merged[col] = {"action": spec.get("action", "keep"), "method": spec.get("method"),
                       "reason": spec.get("reason", "user plan")}
    for col, spec in merged.items():
        if spec["action"] not in ACTIONS:
            raise ValueError(f"{col}: unknown action {spec['action']!r}")
        if spec["method"] not in METHODS[spec["action"]]:
            raise ValueError(f"{col}: method {spec['method']!r} does not fit action {spec['action']!r}")
    inter = []
    for s in interactions or []:
        a, b, kind = s.get("col_a"), s.get("col_b"), s.get("type", "ratio")
        if a not in cols or b not in cols:
            raise ValueError(f"interaction names unknown columns {a!r}, {b!r}")
        if kind not in INTERACTION_TYPES:
            raise ValueError(f"unknown interaction type {kind!r}")
        inter.append({"col_a": a, "col_b": b, "type": kind})
    return merged, inter
