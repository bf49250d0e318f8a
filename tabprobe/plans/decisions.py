"""Preparation decisions as tables (F3, F4, F13, F15, F16): one row per column of facts in, one row per action out.

Facts join the profile, the test signals and the plan by column; every rule is an ordered ``CASE`` over a row of facts,
collinear pairs compare two rows of facts as structs. All tables here have a row per column or per flagged pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the rules
DROP_MISSING_PCT = 80
HIGH_MISSING_PCT = 40
SIGNAL_ABS_R = 0.15
LOW_SIGNAL = {"abs_r": 0.05, "effect": 0.1, "mi": 0.02}
AUTO_WINSOR_OUTLIER_PCT = 5
SKEW_LIMIT = 1
UNINFORMATIVE_TYPES = ("constant", "id")
STRONG_EFFECTS = ("medium", "large")
#: signals that a drop for want of signal needs; where the table of signals has no such column, none is measured
NEEDED_SIGNALS = ("abs_r", "effect_size", "mi_score")
DECIDED_ACTIONS = ("transform", "encode", "keep")

PROFILE_FACTS = {"semantic_type": "string", "missing_pct": "double", "iqr_outlier_pct": "double", "skewness": "double",
                 "negatives_count": "long", "cardinality_ratio": "double"}
SIGNAL_FACTS = {"significant_after_fdr": "boolean", "effect_label": "string", "effect_size": "double", "mi_score": "double",
                "abs_r": "double", "target_encoding": "boolean"}


def _part(table: DataFrame | None, name: str, wanted: dict[str, str], spark: SparkSession) -> DataFrame:
    """``column`` and the wanted facts of ``table``; NULL where it has no such column."""
    if table is None:
        return spark.createDataFrame([], ", ".join(["column string", *(f"{x} {t}" for x, t in wanted.items())]))
    has = set(table.columns)
    return table.select(F.col(name).alias("column"),
                        *[(F.col(x) if x in has else F.lit(None)).cast(t).alias(x) for x, t in wanted.items()])


def _with_defaults(facts: DataFrame) -> DataFrame:
    zero = {x: F.coalesce(F.col(x), F.lit(0).cast(t)) for x, t in
            {"missing_pct": "double", "iqr_outlier_pct": "double", "skewness": "double", "negatives_count": "long",
             "cardinality_ratio": "double", "effect_size": "double", "mi_score": "double", "abs_r": "double"}.items()}
    false = {x: F.coalesce(F.col(x), F.lit(False)) for x in ("significant", "strong", "target_encoding", "is_source",
                                                             *(f"has_{x}" for x in NEEDED_SIGNALS))}
    return facts.withColumns({**zero, **false})


def column_facts(spark: SparkSession, columns: Iterable[str], profile: DataFrame | None, signals: DataFrame | None,
                 plan: dict, sources: Iterable[str] = ()) -> DataFrame:
    """One row per column: profile ⋈ signals ⋈ plan, computed once and kept as a local table (a row per column).

    A signal without a value for a column counts as 0; one that ``signals`` has no column for is unknown (``has_...``).
    """
    sources = set(sources)
    planned = [(i, x, plan.get(x, {}).get("action"), plan.get(x, {}).get("method"), x in sources) for i, x in enumerate(columns)]
    base = spark.createDataFrame(planned, "pos int, column string, plan_action string, plan_method string, is_source boolean")
    facts = (base.join(_part(profile, "column", PROFILE_FACTS, spark), "column", "left")
             .join(_part(signals, "feature", SIGNAL_FACTS, spark), "column", "left"))
    facts = (facts.withColumn("significant", F.col("significant_after_fdr"))
             .withColumn("strong", F.coalesce(F.col("significant"), F.lit(False))
                         | F.coalesce(F.col("effect_label").isin(*STRONG_EFFECTS), F.lit(False)))
             .drop("significant_after_fdr", "effect_label")
             .withColumns({f"has_{x}": F.lit(signals is not None and x in signals.columns) for x in NEEDED_SIGNALS}))
    facts = _with_defaults(facts)
    return spark.createDataFrame(facts.collect(), facts.schema)


def facts_of(facts: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The facts of ``columns`` in their order; columns made since (without facts) take the defaults."""
    now = facts.sparkSession.createDataFrame(list(enumerate(columns)), "pos int, column string")
    return _with_defaults(now.join(facts.drop("pos"), "column", "left"))


def drop_decisions(facts: DataFrame) -> DataFrame:
    """``column, reason, deferred``. Interaction sources go only by plan, once interactions exist (deferred)."""
    rules: list[tuple[Column, str]] = [
        (F.col("plan_action") == "drop", "plan"),
        (F.col("is_source"), None),
        (F.col("semantic_type").isin(*UNINFORMATIVE_TYPES) & ~F.col("strong"), "constant_or_id"),
        (F.col("missing_pct") >= DROP_MISSING_PCT, "mostly_missing"),
        ((F.col("missing_pct") > HIGH_MISSING_PCT) & ~F.col("strong") & F.col("has_abs_r")
         & (F.col("abs_r") < SIGNAL_ABS_R), "high_missing_no_signal")]
    return (facts.select("pos", "column", _first_rule(rules).alias("reason"), F.col("is_source").alias("deferred"))
            .where(F.col("reason").isNotNull()).orderBy("pos").drop("pos"))


def _first_rule(rules: Sequence[tuple[Column, str | None]]) -> Column:
    """The label of the first rule that holds."""
    out = F.when(rules[0][0], F.lit(rules[0][1]).cast("string"))
    for holds, label in rules[1:]:
        out = out.when(holds, F.lit(label).cast("string"))
    return out


def needs_bounds(facts: DataFrame) -> DataFrame:
    """Columns that a plan or the outlier rule may winsorize: their IQR bounds are needed to decide."""
    by_plan = (F.col("plan_action") == "transform") & (F.col("plan_method") == "winsorize")
    return facts.where(F.coalesce(by_plan, F.lit(False)) | (F.col("iqr_outlier_pct") > AUTO_WINSOR_OUTLIER_PCT)).select("column")


def transform_decisions(facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """``column, method, reason`` in the order of application.

    ``ranges``: ``column, low, has_bounds`` (minimum; whether IQR bounds exist) of the numeric columns. A planned method
    that the column's range allows is taken alone; otherwise the rules: winsorize, then a power transform of skewed columns.
    """
    low, method = F.col("low"), F.col("plan_method")
    allowed = _first_rule([
        (F.coalesce(F.col("plan_action"), F.lit("")) != "transform", None),
        ((method == "log1p") & (low > -1), "log1p"), ((method == "sqrt") & (low >= 0), "sqrt"),
        ((method == "winsorize") & F.col("has_bounds"), "winsorize"),
        (method == "yeo_johnson", "yeo_johnson"), (method == "bin_quantile", "bin_quantile")])
    clip = F.when((F.col("iqr_outlier_pct") > AUTO_WINSOR_OUTLIER_PCT) & F.col("has_bounds"), F.lit("winsorize"))
    skewed = F.abs("skewness") > SKEW_LIMIT
    power = _first_rule([(skewed & (F.col("negatives_count") > 0), "yeo_johnson"), (skewed & (low > -1), "log1p")])
    steps = F.when(allowed.isNotNull(), F.array(F.struct(allowed.alias("method"), F.lit("plan").alias("reason")))).otherwise(
        F.array(*[F.struct(m.alias("method"), F.lit("rule").alias("reason")) for m in (clip, power)]))
    told = facts.join(ranges, "column").select("pos", "column", F.posexplode(steps).alias("step", "s"))
    return (told.where(F.col("s.method").isNotNull()).orderBy("pos", "step")
            .select("column", F.col("s.method").alias("method"), F.col("s.reason").alias("reason")))


def low_signal_decisions(facts: DataFrame, kept: Iterable[str] = (), tested: DataFrame | None = None) -> DataFrame:
    """columns below every signal threshold, if any of the ``tested`` (default: these) columns is significant.

    ``kept`` are never named, nor any column where one of the signals was not measured.
    """
    if not (facts if tested is None else tested).where("significant").take(1):
        return facts.select("column").limit(0)
    measured = F.col("has_abs_r") & F.col("has_effect_size") & F.col("has_mi_score")
    weak = (measured & (F.col("abs_r") < LOW_SIGNAL["abs_r"]) & (F.col("effect_size") < LOW_SIGNAL["effect"])
            & (F.col("mi_score") < LOW_SIGNAL["mi"]))
    decided = F.coalesce(F.col("plan_action").isin(*DECIDED_ACTIONS), F.lit(False))
    free = facts.where(weak & ~decided & ~F.col("strong") & ~F.col("is_source"))
    return free.where(~F.col("column").isin(list(kept))).orderBy("pos").select("column")


def collinear_decisions(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """F16: of each pair ``col_a, col_b`` the lower (significant, |r|, effect) goes, the second on ties; strong ones stay."""
    side = F.struct("significant", "abs_r", "effect_size", "strong")
    a = facts.select(F.col("column").alias("col_a"), side.alias("a"))
    b = facts.select(F.col("column").alias("col_b"), side.alias("b"))

    def rank(x: str) -> Column:
        return F.struct(*[F.col(f"{x}.{f}").alias(f) for f in ("significant", "abs_r", "effect_size")])

    first_stays = rank("a") >= rank("b")
    lost = pairs.join(a, "col_a").join(b, "col_b").select(
        F.when(first_stays, F.col("col_b")).otherwise(F.col("col_a")).alias("column"),
        F.when(first_stays, F.col("b.strong")).otherwise(F.col("a.strong")).alias("strong"))
    return lost.where(~F.col("strong")).select("column").distinct().orderBy("column")
