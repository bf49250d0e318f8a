"""Column profile (B1–B16): one row per column, computed from per-column value counts.

For each physical kind (numeric / string / datetime) the table is melted to
``(column, value)`` and counted once: ``(column, value, t)`` — one shuffle,
combined map-side, so hot values collapse to one row. Everything else is
derived from those counts, which are never larger than the input and usually
far smaller: non-null and distinct counts, min / max, exact central moments,
exact quantiles (ranks.quantiles_from_counts), outlier counts, top-k and
entropy, the boolean / datetime tests (run once per distinct value).
Only per-column rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.columns import c, is_bool, is_datetime, is_float, is_numeric, is_string, r4, rnd
from tabprobe.functions.joins import bounded_broadcast
from tabprobe.functions.moments import chi2_sf_2dof, sample_kurt, sample_skew, with_dagostino
from tabprobe.functions.shapiro import shapiro_wilk
from tabprobe.operators import ranks
from tabprobe.operators.longform import label_long, melt, numeric_long

# ── fixed values of the reference's rules ─────────────────────────────────────
BOOLEAN_WORDS = ["yes", "no", "y", "n", "true", "false"]
ID_NAME_MARKERS = ["_id", "id_", " id", "uuid", "key"]
# A string column is datetime-like when every non-null value has this shape and parses.
DATETIME_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
TEXT_MEAN_LENGTH = 50
ORDINAL_MAX_UNIQUE = 15
ORDINAL_MAX_RATIO = 0.05
CATEGORICAL_MAX_RATIO = 0.5
ID_MIN_RATIO = 0.9
SHAPIRO_MAX_N = 2000
SHAPIRO_SAMPLE = 500
NORMALITY_MIN_N = 8
ALPHA = 0.05

_LEVEL = StorageLevel.MEMORY_AND_DISK


def column_kind(dt: T.DataType) -> str:
    if is_numeric(dt) or is_bool(dt):
        return "numeric"
    if is_string(dt):
        return "string"
    if is_datetime(dt):
        return "datetime"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: column_kind(f.dataType) for f in df.schema.fields}


def _freeze(df: DataFrame) -> DataFrame:
    """Collect a per-column result (few rows) and rebuild it, so later steps do not recompute it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _meta(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = [(name, i, df.schema[name].dataType.simpleString(), column_kind(df.schema[name].dataType))
            for i, name in enumerate(df.columns) if name in set(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, pos int, dtype string, kind string")


# ── value counts per kind (NULL kept as its own value, for the missing count) ─

def numeric_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return numeric_long(df, cols).groupBy("column", "value").agg(F.count("*").alias("t"))


def string_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return melt(df, cols, lambda d, n: c(n).cast("string"), value_type="string").groupBy("column", "value").agg(
        F.count("*").alias("t"))


def datetime_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return melt(df, cols, lambda d, n: c(n).cast("timestamp_ntz"), value_type="timestamp_ntz").groupBy(
        "column", "value").agg(F.count("*").alias("t"))


def _parses(v: F.Column) -> F.Column:
    return F.coalesce(v.rlike(DATETIME_PATTERN) & F.try_to_timestamp(v).isNotNull(), F.lit(False))


def _basics_from_counts(vc: DataFrame, kind: str) -> DataFrame:
    v, t = F.col("value"), F.col("t")
    nn = v.isNotNull()
    common = [F.sum("t").alias("n_rows"), F.coalesce(F.sum(F.when(nn, t)), F.lit(0)).cast("long").alias("n"),
              F.count(v).alias("nunique")]
    if kind == "numeric":
        extra = [(F.sum(F.when(nn & ~v.isin(0.0, 1.0), 1).otherwise(0)) == 0).alias("bool_ok"),
                 F.lit(False).alias("parse_ok"), F.lit(None).cast("double").alias("avg_len")]
    elif kind == "string":
        extra = [(F.sum(F.when(nn & ~v.isin(*BOOLEAN_WORDS), 1).otherwise(0)) == 0).alias("bool_ok"),
                 ((F.sum(F.when(nn & ~_parses(v), 1).otherwise(0)) == 0) & (F.count(v) > 0)).alias("parse_ok"),
                 (F.sum(F.when(nn, t * F.length(v))) / F.sum(F.when(nn, t))).cast("double").alias("avg_len")]
    else:
        extra = [F.lit(False).alias("bool_ok"), F.lit(False).alias("parse_ok"), F.lit(None).cast("double").alias("avg_len")]
    return vc.groupBy("column").agg(*common, *extra)


def _other_basics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    lg = melt(df, cols, lambda d, n: c(n).isNotNull(), value_type="boolean")
    return lg.groupBy("column").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("value")).alias("n"), F.lit(None).cast("long").alias("nunique"),
        F.lit(False).alias("bool_ok"), F.lit(False).alias("parse_ok"), F.lit(None).cast("double").alias("avg_len"))


class Counts:
    """The per-kind value-count tables of one DataFrame, persisted while a profile is built."""

    def __init__(self, df: DataFrame, cols: Sequence[str] | None = None, persist: bool = True):
        cols = list(df.columns if cols is None else cols)
        kd = kinds(df)
        self.df = df
        self.cols = cols
        self.by_kind = {k: [x for x in cols if kd[x] == k] for k in ("numeric", "string", "datetime", "other")}
        self.vc = {}
        build = {"numeric": numeric_counts, "string": string_counts, "datetime": datetime_counts}
        for k, fn in build.items():
            if self.by_kind[k]:
                t = fn(df, self.by_kind[k])
                self.vc[k] = t.persist(_LEVEL) if persist else t

    def basics(self) -> DataFrame:
        parts = [_basics_from_counts(v, k) for k, v in self.vc.items()]
        if self.by_kind["other"]:
            parts.append(_other_basics(self.df, self.by_kind["other"]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        # left join from the schema: an empty table still gets one row per column (zero counts)
        out = _meta(self.df, self.cols).join(out, "column", "left").fillna(0, ["n_rows", "n"]).fillna(
            False, ["bool_ok", "parse_ok"])
        out = out.withColumn("nunique", F.when(F.col("kind") != "other", F.coalesce("nunique", F.lit(0))))
        return out.withColumn("missing", F.col("n_rows") - F.col("n"))

    def release(self) -> None:
        for v in self.vc.values():
            v.unpersist()


def column_basics(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, pos, dtype, kind, n_rows, n, missing, nunique, bool_ok, parse_ok, avg_len)``."""
    return Counts(df, cols, persist=False).basics()


def semantic_type_expr() -> F.Column:
    """The eight rules, in the reference's order, over a ``column_basics`` row."""
    n, u, kind = F.col("n"), F.col("nunique"), F.col("kind")
    ratio = u / F.greatest(n, F.lit(1))
    lname = F.lower(F.col("column"))
    name_is_id = None
    for m in ID_NAME_MARKERS:
        x = F.instr(lname, m) > 0
        name_is_id = x if name_is_id is None else (name_is_id | x)
    return (F.when(kind == "other", F.lit("unsupported"))
            .when(u <= 1, F.lit("constant"))
            .when(F.col("bool_ok"), F.lit("boolean"))
            .when(name_is_id & (ratio > ID_MIN_RATIO), F.lit("id"))
            .when(kind == "datetime", F.lit("datetime"))
            .when((kind == "string") & F.col("parse_ok"), F.lit("datetime_string"))
            .when((kind == "string") & (F.col("avg_len") > TEXT_MEAN_LENGTH), F.lit("text"))
            .when((kind == "numeric") & (u == 2), F.lit("binary_numeric"))
            .when((kind == "numeric") & ((u <= ORDINAL_MAX_UNIQUE) | (ratio < ORDINAL_MAX_RATIO)),
                  F.lit("ordinal_or_categorical_numeric"))
            .when(kind == "numeric", F.lit("continuous"))
            .when(ratio < CATEGORICAL_MAX_RATIO, F.lit("categorical"))
            .otherwise(F.lit("text")))


def profile_route_expr() -> F.Column:
    """Which profile a column gets: numeric / datetime / categorical (none for unsupported)."""
    sem, kind = F.col("semantic_type"), F.col("kind")
    return (F.when(sem == "unsupported", F.lit(None).cast("string"))
            .when((kind == "numeric") & ~sem.isin("boolean", "id", "constant"), F.lit("numeric"))
            .when(sem.isin("datetime", "datetime_string"), F.lit("datetime"))
            .otherwise(F.lit("categorical")))


def with_semantics(basics: DataFrame, target: str | None = None) -> DataFrame:
    return (basics.withColumn("semantic_type", semantic_type_expr())
            .withColumn("profile_type", profile_route_expr())
            .withColumn("missing_pct", rnd(F.try_divide(F.col("missing") * 100.0, F.col("n_rows")), 2))
            .withColumn("cardinality", F.col("nunique"))
            .withColumn("is_target", F.col("column") == F.lit(target) if target else F.lit(False)))


def semantic_types(df: DataFrame, cols: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """B1 + B2 + B3: type, missing count / % and cardinality per column."""
    return with_semantics(column_basics(df, cols), target)


# ── numeric profile from counts ───────────────────────────────────────────────

def row_stats(df: DataFrame, cols: Sequence[str], rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """As ``numeric_stats``, straight from the rows: moments in one map-side aggregation, quartiles by bracketed selection.

    No column's values are shuffled, however many distinct ones it has. Returns a small frozen DataFrame.
    """
    from tabprobe.operators.selection import bracketed_wide

    v = F.col("value")
    lg = numeric_long(df, cols).where(v.isNotNull())
    a1 = _freeze(lg.groupBy("column").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v == 0).alias("zeros"),
        F.count_if(v < 0).alias("negatives"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("sd_pop"),
        F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")))
    qs = bracketed_wide(lg, {"q1": 0.25, "median": 0.5, "q3": 0.75}, rows_per_bucket=rows_per_bucket)
    base = _freeze(a1.join(qs, "column", "left"))
    iqr = F.col("q3") - F.col("q1")
    bounds = base.select("column", "mean", "sd_pop", (F.col("q1") - 1.5 * iqr).alias("lower"), (F.col("q3") + 1.5 * iqr).alias("upper"))
    outl = lg.join(bounded_broadcast(bounds, len(cols)), "column").groupBy("column").agg(
        F.count_if((v < F.col("lower")) | (v > F.col("upper"))).alias("iqr_out"),
        F.count_if((F.col("sd_pop") > 0) & (F.abs(v - F.col("mean")) > 3 * F.col("sd_pop"))).alias("z_out"))
    return _freeze(base.join(outl, "column", "left"))


def numeric_stats(nvc: DataFrame, rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """Per column n, mean, std, var, min, max, g1, g2, sd_pop, zeros, negatives, q1, median, q3, outlier counts.

    Central moments come from a second pass over the counts with the exact mean
    (stable, unlike raw power sums). Returns a small frozen DataFrame.
    """
    v, t = F.col("value"), F.col("t")
    vc = nvc.where(v.isNotNull())
    a1 = _freeze(vc.groupBy("column").agg(
        F.sum("t").alias("n"), (F.sum(t * v) / F.sum("t")).alias("mean"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.coalesce(F.sum(F.when(v == 0, t)), F.lit(0)).alias("zeros"),
        F.coalesce(F.sum(F.when(v < 0, t)), F.lit(0)).alias("negatives"), F.count("*").alias("distinct")))
    meta = {r["column"]: r for r in a1.collect()}
    n_cols = len(meta)
    d = v - F.col("mean")
    a2 = (vc.join(bounded_broadcast(a1.select("column", "mean"), n_cols), "column").groupBy("column").agg(
        F.sum(t * d * d).alias("m2"), F.sum(t * d * d * d).alias("m3"), F.sum(t * d * d * d * d).alias("m4")))
    d_max = max([r["distinct"] for r in meta.values()] or [0])
    qs = ranks.pivot_quantiles(
        ranks.quantiles_from_counts(vc, [0.25, 0.5, 0.75], sizes=(d_max, n_cols), rows_per_bucket=rows_per_bucket),
        {"q1": 0.25, "median": 0.5, "q3": 0.75})
    base = _freeze(a1.join(a2, "column").join(qs, "column", "left"))
    n = F.col("n").cast("double")
    base = base.select(
        "*", F.try_divide(F.col("m2"), n - 1).alias("variance"), F.sqrt(F.try_divide(F.col("m2"), n - 1)).alias("std"),
        F.sqrt(F.col("m2") / n).alias("sd_pop"),
        F.when(F.col("m2") > 0, (F.col("m3") / n) / F.pow(F.col("m2") / n, 1.5)).alias("g1"),
        F.when(F.col("m2") > 0, (F.col("m4") / n) / ((F.col("m2") / n) * (F.col("m2") / n)) - 3).alias("g2"))
    iqr = F.col("q3") - F.col("q1")
    bounds = base.select("column", "mean", "sd_pop", (F.col("q1") - 1.5 * iqr).alias("lower"),
                         (F.col("q3") + 1.5 * iqr).alias("upper"))
    outl = (vc.join(bounded_broadcast(bounds, n_cols), "column").groupBy("column").agg(
        F.coalesce(F.sum(F.when((v < F.col("lower")) | (v > F.col("upper")), t)), F.lit(0)).alias("iqr_out"),
        F.coalesce(F.sum(F.when((F.col("sd_pop") > 0) & (F.abs(v - F.col("mean")) > 3 * F.col("sd_pop")), t)),
                   F.lit(0)).alias("z_out")))
    return _freeze(base.join(outl, "column", "left"))


def shapiro_by_group(long_df: DataFrame, group_cols: Sequence[str], sample: int = SHAPIRO_SAMPLE,
                     seed: int = 42, sizes: DataFrame | None = None, n_groups: int = 0) -> DataFrame:
    """``(group..., sw_stat, sw_p)`` on a seeded ≤ ``sample``-row sample per group.

    Rows are drawn by a hash of their value and their number among equal values, so the draw is the same however the rows
    are stored or split. The sample is a row_number ≤ k window (planned as a WindowGroupLimit, so only
    k rows per group and map task are shuffled); the test runs in one bounded
    ``applyInPandas`` group.
    """
    group_cols = list(group_cols)
    counts = ranks.value_counts(long_df, group_cols)
    u = counts.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("t")))).drop("t")
    u = u.withColumn("__u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "value", "__i"), 11) / F.lit(float(1 << 53)))
    if sizes is not None:
        # Bernoulli pre-filter at ~4× the sample size per group: the k smallest keys survive it (unless
        # fewer than k pass, which is vanishingly rare), so the sample is unchanged but the sort is small.
        fr = sizes.select(*group_cols, F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("n")).alias("__frac"))
        u = (u.join(bounded_broadcast(fr, n_groups), group_cols, "left")
             .where(F.col("__u") < F.coalesce(F.col("__frac"), F.lit(1.0))).drop("__frac"))
    w = Window.partitionBy(*group_cols).orderBy("__u", "value", "__i")
    samp = u.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= sample)
    schema = T.StructType([long_df.schema[g] for g in group_cols]
                          + [T.StructField("sw_stat", T.DoubleType()), T.StructField("sw_p", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wv, pv = shapiro_wilk(pdf["value"].to_numpy())
        row = {g: [pdf[g].iloc[0]] for g in group_cols}
        row.update({"sw_stat": [wv], "sw_p": [pv]})
        return pd.DataFrame(row)

    return samp.select(*group_cols, "value").groupBy(*group_cols).applyInPandas(run, schema)


def _numeric_profile(df: DataFrame, res: DataFrame, with_shapiro: bool) -> DataFrame:
    """The finished numeric profile from ``numeric_stats`` or ``row_stats``."""
    small = [r["column"] for r in res.select("column", "n").collect()
             if NORMALITY_MIN_N <= (r["n"] or 0) <= SHAPIRO_MAX_N]
    if with_shapiro and small:
        sw = _freeze(shapiro_by_group(numeric_long(df, small), ["column"]))
        res = res.join(sw, "column", "left")
    else:
        res = res.withColumn("sw_stat", F.lit(None).cast("double")).withColumn("sw_p", F.lit(None).cast("double"))
    return finish_numeric(res)


def numeric_summary(df: DataFrame, cols: Sequence[str], rows_per_bucket: int = ranks.ROWS_PER_BUCKET,
                    with_shapiro: bool = True) -> DataFrame:
    """B4–B10 for numeric columns: one row per column (values rounded as the reference reports them)."""
    return _freeze(_numeric_profile(df, row_stats(df, cols, rows_per_bucket), with_shapiro))


def finish_numeric(res: DataFrame) -> DataFrame:
    n = F.col("n")
    skew, kurt = sample_skew(F.col("g1"), n), sample_kurt(F.col("g2"), n)
    res = with_dagostino(res)
    k2 = F.col("k2")
    has_out = n >= 4
    pct = lambda x: rnd(F.try_divide(x * 100.0, n), 2)
    test = (F.when(n < NORMALITY_MIN_N, F.lit("insufficient_data"))
            .when(n <= SHAPIRO_MAX_N, F.lit("shapiro_wilk")).otherwise(F.lit("dagostino_pearson")))
    stat = F.when(n < NORMALITY_MIN_N, None).when(n <= SHAPIRO_MAX_N, F.col("sw_stat")).otherwise(k2)
    pval = F.when(n < NORMALITY_MIN_N, None).when(n <= SHAPIRO_MAX_N, F.col("sw_p")).otherwise(chi2_sf_2dof(k2))
    out = res.select(
        "column", n.alias("count"), r4(F.col("mean")).alias("mean"), r4(F.col("median")).alias("median"),
        r4(F.col("std")).alias("std"), r4(F.col("variance")).alias("variance"),
        r4(F.col("min")).alias("min"), r4(F.col("max")).alias("max"),
        r4(F.col("max") - F.col("min")).alias("range"), r4(F.col("q1")).alias("q1"), r4(F.col("q3")).alias("q3"),
        r4(F.col("q3") - F.col("q1")).alias("iqr"), r4(skew).alias("skewness"), r4(kurt).alias("kurtosis"),
        F.when(F.col("mean") != 0, r4(F.col("std") / F.col("mean"))).alias("cv"),
        F.col("zeros").alias("zeros_count"), pct(F.col("zeros")).alias("zeros_pct"),
        F.col("negatives").alias("negatives_count"),
        F.when(has_out, F.col("iqr_out")).alias("iqr_outlier_count"),
        F.when(has_out, pct(F.col("iqr_out"))).alias("iqr_outlier_pct"),
        F.when(has_out, F.col("z_out")).alias("zscore_outlier_count"),
        F.when(has_out, pct(F.col("z_out"))).alias("zscore_outlier_pct"),
        F.when(has_out, r4(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))).alias("iqr_lower_bound"),
        F.when(has_out, r4(F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))).alias("iqr_upper_bound"),
        test.alias("normality_test"), r4(stat).alias("normality_stat"), r4(pval).alias("normality_p"),
        F.when(n >= NORMALITY_MIN_N, pval > ALPHA).alias("is_normal"))
    return out.withColumn("distribution_shape", shape_expr(F.col("skewness"), F.col("kurtosis")))


def shape_expr(skew: F.Column, kurt: F.Column) -> F.Column:
    """B10 on the rounded skewness / kurtosis."""
    return (F.when((F.abs(skew) < 0.5) & (F.abs(kurt) < 1), F.lit("normal-like"))
            .when(skew > 1, F.lit("right-skewed"))
            .when(skew < -1, F.lit("left-skewed"))
            .when(kurt > 3, F.lit("leptokurtic (heavy tails)"))
            .when(kurt < -1, F.lit("platykurtic (light tails)"))
            .otherwise(F.lit("moderate")))


# ── categorical profile ───────────────────────────────────────────────────────

def label_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` for non-null labels (map-side combined, hot values collapse)."""
    return (label_long(df, cols).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count("*").alias("count")))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """``(column, rank, value, count)``: k most frequent per column, ties by value.

    ``row_number() <= k`` is planned as a WindowGroupLimit before the shuffle,
    so a column with millions of levels sends only k rows per map task.
    """
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column", F.col("rank").cast("long").alias("rank"), "value", "count"))


def categorical_from_counts(counts: DataFrame) -> DataFrame:
    """B11–B13 from ``(column, value, count)``: count, unique, top/bottom value, entropy, dominance, ratio."""
    tot = counts.groupBy("column").agg(F.sum("count").alias("n"), F.count("*").alias("unique_values"))
    withn = counts.join(tot, "column")
    p = F.col("count") / F.col("n")
    ent = withn.groupBy("column").agg(F.sum(-p * F.log2(p + F.lit(1e-9))).alias("entropy"))
    top = top_values(counts, 1).select("column", F.col("value").alias("top_value"), F.col("count").alias("top_count"))
    wb = Window.partitionBy("column").orderBy(F.col("count").asc(), F.col("value").desc())
    bottom = (counts.withColumn("r", F.row_number().over(wb)).where(F.col("r") == 1)
              .select("column", F.col("value").alias("bottom_value"), F.col("count").alias("bottom_value_count")))
    res = tot.join(ent, "column").join(top, "column").join(bottom, "column")
    return res.select(
        "column", F.col("n").alias("count"), "unique_values", "top_value",
        rnd(F.col("top_count") * 100.0 / F.col("n"), 2).alias("top_value_pct"),
        "bottom_value", "bottom_value_count", r4(F.col("entropy")).alias("entropy"), "top_count",
        r4(F.col("top_count") / F.col("n")).alias("dominance"),
        r4(F.col("unique_values") / F.greatest(F.col("n"), F.lit(1))).alias("cardinality_ratio"))


def categorical_summary(df: DataFrame, cols: Sequence[str], top_k: int = 5) -> DataFrame:
    """B11–B13 for the given columns (labels as pandas prints them)."""
    return categorical_from_counts(label_counts(df, cols))


def _labels_from_numeric_counts(df: DataFrame, nvc: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Label counts of numeric columns routed to the categorical profile (booleans, ids, constants)."""
    v = F.col("value")
    lab = None
    for x in cols:
        dt = df.schema[x].dataType
        e = (F.when(v == 1, "True").otherwise("False") if is_bool(dt)
             else v.cast("string") if is_float(dt) else v.cast("long").cast("string"))
        lab = F.when(F.col("column") == x, e) if lab is None else lab.when(F.col("column") == x, e)
    return (nvc.where(F.col("column").isin(*cols) & v.isNotNull())
            .select("column", lab.alias("value"), F.col("t").alias("count")))


# ── datetime profile ──────────────────────────────────────────────────────────

def _datetime_from_counts(dvc: DataFrame) -> DataFrame:
    v = F.col("value")
    agg = dvc.where(v.isNotNull()).groupBy("column").agg(
        F.sum("t").alias("count"), F.min(v).alias("tmin"), F.max(v).alias("tmax"), F.count("*").alias("unique_dates"))
    secs = F.unix_micros(F.col("tmax").cast("timestamp")) - F.unix_micros(F.col("tmin").cast("timestamp"))
    return agg.select("column", "count", F.col("tmin").cast("string").alias("min"),
                      F.col("tmax").cast("string").alias("max"),
                      F.floor(secs / F.lit(86_400_000_000)).cast("long").alias("range_days"), "unique_dates")


def datetime_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, min, max, whole-day range, distinct values."""
    kd = kinds(df)

    def as_ts(d, name):
        return c(name).cast("timestamp_ntz") if kd[name] == "datetime" else F.try_to_timestamp(c(name)).cast("timestamp_ntz")

    lg = melt(df, cols, as_ts, value_type="timestamp_ntz")
    return _datetime_from_counts(lg.groupBy("column", "value").agg(F.count("*").alias("t")))


# ── all together ──────────────────────────────────────────────────────────────

def profile_columns(df: DataFrame, target: str | None = None, rows_per_bucket: int = ranks.ROWS_PER_BUCKET,
                    with_shapiro: bool = True) -> DataFrame:
    """One row per column: semantic type, missing, cardinality and the profile of its route.

    One counting shuffle per physical kind; the per-column result is collected
    (one row per column) and returned as a small local DataFrame.
    """
    counts = Counts(df)
    try:
        sem = _freeze(with_semantics(counts.basics(), target))
        routes = {r["column"]: (r["profile_type"], r["kind"]) for r in sem.select("column", "profile_type", "kind").collect()}
        num = [x for x in df.columns if routes.get(x, (None,))[0] == "numeric"]
        cat_s = [x for x in df.columns if routes.get(x) == ("categorical", "string")]
        cat_n = [x for x in df.columns if routes.get(x) == ("categorical", "numeric")]
        dts = [x for x in df.columns if routes.get(x) == ("datetime", "datetime")]
        dstr = [x for x in df.columns if routes.get(x) == ("datetime", "string")]
        parts = []
        if num:
            nvc = counts.vc["numeric"].where(F.col("column").isin(*num))
            parts.append(_numeric_profile(df, numeric_stats(nvc, rows_per_bucket), with_shapiro))
        cat_parts = []
        if cat_s:
            cat_parts.append(counts.vc["string"].where(F.col("column").isin(*cat_s) & F.col("value").isNotNull())
                             .select("column", "value", F.col("t").alias("count")))
        if cat_n:
            cat_parts.append(_labels_from_numeric_counts(df, counts.vc["numeric"], cat_n))
        if cat_parts:
            cc = cat_parts[0] if len(cat_parts) == 1 else cat_parts[0].unionByName(cat_parts[1])
            parts.append(categorical_from_counts(cc))
        dparts = []
        if dts:
            dparts.append(counts.vc["datetime"].where(F.col("column").isin(*dts)))
        if dstr:
            dparts.append(counts.vc["string"].where(F.col("column").isin(*dstr)).select(
                "column", F.try_to_timestamp("value").cast("timestamp_ntz").alias("value"), "t"))
        if dparts:
            dd = dparts[0] if len(dparts) == 1 else dparts[0].unionByName(dparts[1])
            parts.append(_datetime_from_counts(dd).withColumnsRenamed({"min": "min_time", "max": "max_time"}))
        body = None
        for p in parts:
            body = p if body is None else body.unionByName(p, allowMissingColumns=True)
        out = sem.select("column", "pos", "dtype", "kind", "semantic_type", "profile_type", "n_rows",
                         F.col("missing").alias("missing_count"), "missing_pct", "cardinality", "is_target")
        if body is not None:
            out = out.join(body, "column", "left")
        return _freeze(out)
    finally:
        counts.release()


def column_type_lists(sem: DataFrame) -> DataFrame:
    """Columns per semantic type, names in table order."""
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "column"))), lambda x: x["column"]), ",")
    return sem.groupBy("semantic_type").agg(F.count("*").alias("n_columns"), names.alias("columns"))


_WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1,
           "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, cells and size in MB (fixed type widths + string bytes)."""
    size = None
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        part = (F.coalesce(F.sum(F.octet_length(c(f.name))), F.lit(0)) if is_string(f.dataType)
                else F.count(F.lit(1)) * _WIDTHS.get(st, 8))
        size = part if size is None else size + part
    k = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("num_rows"), (size.cast("double") / 1048576).alias("mb")).select(
        "num_rows", F.lit(k).cast("long").alias("num_columns"), (F.col("num_rows") * k).alias("total_cells"),
        rnd(F.col("mb"), 3).alias("memory_usage_mb"))
