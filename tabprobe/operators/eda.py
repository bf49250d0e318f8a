"""EDA products (D1–D16): the numbers behind each plot, as small DataFrames.

Row-level data never goes to the driver: a plot reads a histogram, a box, a
crosstab or a bounded sample, each computed by Spark over the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.columns import as_double, as_label, c, r4, rnd
from tabprobe.functions.joins import bounded_broadcast
from tabprobe.functions.keyhash import key_hash
from tabprobe.operators import profile as P
from tabprobe.operators import quality as Q
from tabprobe.operators import ranks
from tabprobe.operators.selection import bracketed_wide
from tabprobe.operators.longform import label_long, numeric_long

# fixed thresholds of the reference's insight rules
PLOT_SAMPLE = 3000
STRONG_TARGET_R = 0.5
WEAK_TARGET_R = 0.05
COLLINEAR_R = 0.85
HIGH_MISSING = 0.4
IMBALANCE_RATIO = 0.2
INSIGHT_SKEW = 1
INSIGHT_OUTLIER_PCT = 5
INSIGHT_DOMINANCE = 0.90
INSIGHT_CARDINALITY = 50


def stable_sample(df: DataFrame, key: str, n: int = PLOT_SAMPLE) -> DataFrame:
    """At most ``n`` rows, the ones with the smallest key hash (a top-k, not a shuffle sort)."""
    return df.withColumn("__h", key_hash(c(key))).orderBy("__h", key).limit(n).drop("__h")


def eda_numeric(df: DataFrame, cols: Sequence[str], **kw) -> DataFrame:
    """Distribution statistics per numeric column on the full data."""
    s = P.numeric_summary(df, cols, **kw)
    return s.select("column", "mean", "median", "std", F.col("skewness").alias("skew"), "kurtosis", "q1", "q3", "iqr",
                    F.col("iqr_outlier_pct").alias("outlier_pct"), "is_normal", "normality_p")


def _minmax(lg: DataFrame) -> DataFrame:
    return lg.groupBy("column").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.count("value").alias("n"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """D3: equal-width bins per column ``(column, bin, lower, upper, count)``; the max lands in the last bin."""
    lg = numeric_long(df, cols).where(F.col("value").isNotNull())
    mm = _minmax(lg)
    w = (F.col("vmax") - F.col("vmin")) / bins
    b = F.when(F.col("vmax") == F.col("vmin"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("vmin")) / w), F.lit(bins - 1))).cast("long")
    h = (lg.join(bounded_broadcast(mm, len(cols)), "column").withColumn("bin", b)
         .groupBy("column", "bin", "vmin", "vmax").agg(F.count("*").alias("count")))
    return h.select("column", "bin", r4(F.col("vmin") + F.col("bin") * w).alias("lower"),
                    r4(F.col("vmin") + (F.col("bin") + 1) * w).alias("upper"), "count")


def density_curve(df: DataFrame, cols: Sequence[str], points: int = 200, grid_bins: int = 1024) -> DataFrame:
    """Gaussian KDE (Scott bandwidth h = sd·n^(−1/5)) on ``points`` grid values from min to max.

    Binned evaluation: rows are counted into ``grid_bins`` equal-width bins first,
    so the kernel sum costs points × bins per column whatever the row count.
    """
    lg = numeric_long(df, cols).where(F.col("value").isNotNull())
    st = lg.groupBy("column").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"),
                                  F.count("value").alias("n"), F.stddev_samp("value").alias("sd"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    bw = (F.col("vmax") - F.col("vmin")) / grid_bins
    fine = (lg.join(bounded_broadcast(st, len(cols)), "column")
            .withColumn("fb", F.when(F.col("vmax") == F.col("vmin"), F.lit(0))
                        .otherwise(F.least(F.floor((F.col("value") - F.col("vmin")) / bw), F.lit(grid_bins - 1))))
            .groupBy("column", "fb").agg(F.count("*").alias("cnt")))
    grid = st.select("column", "vmin", "vmax", "n", "h",
                     F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"))
    grid = grid.withColumn("x", F.col("vmin") + F.col("j") * (F.col("vmax") - F.col("vmin")) / (points - 1))
    centers = fine.join(bounded_broadcast(st.select("column", "vmin", "vmax"), len(cols)), "column").select(
        "column", "cnt", (F.col("vmin") + (F.col("fb") + 0.5) * bw).alias("cx"))
    # each column pairs ≤ points grid values with ≤ grid_bins bin centres: bounded by parameters, not rows
    z = (F.col("x") - F.col("cx")) / F.col("h")
    dens = (grid.join(centers, "column")
            .groupBy("column", "j", "x", "n", "h")
            .agg(F.sum(F.col("cnt") * F.exp(-0.5 * z * z)).alias("s")))
    return dens.select("column", F.col("j").cast("long").alias("point"), r4(F.col("x")).alias("x"),
                       r4(F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def _box(long_df: DataFrame, g: Sequence[str], rows_per_bucket: int) -> DataFrame:
    """Quartiles, whiskers and outlier count of ``value`` per group ``g``."""
    qs = bracketed_wide(long_df, {"q1": 0.25, "median": 0.5, "q3": 0.75}, g, rows_per_bucket=rows_per_bucket)
    iqr = F.col("q3") - F.col("q1")
    qb = qs.select(*g, "q1", "median", "q3", (F.col("q1") - 1.5 * iqr).alias("lo"), (F.col("q3") + 1.5 * iqr).alias("hi"))
    v = F.col("value")
    agg = long_df.join(qb, list(g)).groupBy(*g, "q1", "median", "q3").agg(
        F.count("*").alias("n"),
        F.min(F.when(v >= F.col("lo"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("hi"), v)).alias("whisker_high"),
        F.count_if((v < F.col("lo")) | (v > F.col("hi"))).alias("n_outliers"))
    return agg.select(*g, "n", r4(F.col("q1")).alias("q1"), r4(F.col("median")).alias("median"),
                      r4(F.col("q3")).alias("q3"), r4(F.col("whisker_low")).alias("whisker_low"),
                      r4(F.col("whisker_high")).alias("whisker_high"), "n_outliers")


ALL_ROWS = "(all)"


def box_stats(df: DataFrame, cols: Sequence[str], by: str | None = None,
              rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (furthest point inside), outlier count — overall or per ``by`` level."""
    if by:
        lg = (numeric_long(df.withColumn("__g", as_label(df, by)), cols, keep=["__g"])
              .withColumnRenamed("__g", "group").where(F.col("group").isNotNull()))
    else:
        lg = numeric_long(df, cols).withColumn("group", F.lit(ALL_ROWS))
    lg = lg.where(F.col("value").isNotNull())
    return _box(lg, ["column", "group"], rows_per_bucket)


def target_regression_line(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Least-squares line of target on each feature (feature NULLs filled with its mean)."""
    y = as_double(df, target)
    lg = numeric_long(df.where(y.isNotNull()), features, keep=[target])
    means = lg.groupBy("column").agg(F.avg("value").alias("m"))
    x = F.coalesce(F.col("value"), F.col("m"))
    yy = F.col(target).cast("double")
    st = (lg.join(bounded_broadcast(means, len(features)), "column").groupBy("column").agg(
        F.regr_slope(yy, x).alias("slope"), F.regr_intercept(yy, x).alias("intercept"),
        F.covar_pop(x, yy).alias("cv"), F.stddev_pop(x).alias("sx"), F.stddev_pop(yy).alias("sy")))
    r = F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("cv") / (F.col("sx") * F.col("sy")))
    return st.select("column", r4(F.col("slope")).alias("slope"), r4(F.col("intercept")).alias("intercept"),
                     r4(r).alias("r"))


def eda_categorical(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Top-k shares (4 dp) per column with unique count and dominance."""
    counts = P.label_counts(df, cols)
    tot = counts.groupBy("column").agg(F.sum("count").alias("n"), F.count("*").alias("unique_values"))
    top = P.top_values(counts, k).join(tot, "column")
    share = F.col("count") / F.col("n")
    dom = F.max(F.when(F.col("rank") == 1, share)).over(Window.partitionBy("column"))
    return top.select("column", "unique_values", "rank", "value", r4(share).alias("share"), r4(dom).alias("dominance"))


def class_mix_by_category(df: DataFrame, cols: Sequence[str], target: str, first: int = 10) -> DataFrame:
    """Row-normalised crosstab category × class, for the first ``first`` categories in sorted order."""
    lg = label_long(df, cols, keep=[target]).where(F.col("value").isNotNull() & c(target).isNotNull())
    cnt = lg.groupBy("column", "value", F.col(target).cast("string").alias("class")).agg(F.count("*").alias("count"))
    levels = cnt.select("column", "value").distinct()
    w = Window.partitionBy("column").orderBy("value")
    keep = levels.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first).drop("r")
    sel = cnt.join(keep, ["column", "value"], "left_semi")
    tot = F.sum("count").over(Window.partitionBy("column", "value"))
    return sel.select("column", "value", "class", "count", r4(F.col("count") / tot).alias("share"))


def target_by_top_categories(df: DataFrame, cols: Sequence[str], target: str, k: int = 8,
                             rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """Target box statistics for the k most frequent levels of each category (semi join on the top-k)."""
    top = P.top_values(P.label_counts(df, cols), k).select("column", "value")
    lg = label_long(df.withColumn("__y", as_double(df, target)), cols, keep=["__y"]).where(F.col("value").isNotNull())
    sel = lg.join(bounded_broadcast(top, k * len(cols)), ["column", "value"], "left_semi")
    long_y = sel.select(F.col("column").alias("feature"), F.col("value").alias("group"),
                        F.col("__y").alias("value")).where(F.col("value").isNotNull())
    return _box(long_y, ["feature", "group"], rows_per_bucket)


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every numeric pair with signed Pearson r (4 dp)."""
    return Q.pearson_pairs(df, cols).select("col_a", "col_b", r4(F.col("r")).alias("r"))


def target_correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """|r| of each numeric feature with the target, strongest first, with a strength label."""
    feats = [x for x in cols if x != target]
    pairs = Q.pearson_pairs(df, feats + [target]).where(F.col("col_b") == target)
    a = F.abs(F.col("r"))
    return pairs.select(F.col("col_a").alias("feature"), r4(a).alias("abs_r"),
                        F.when(a > STRONG_TARGET_R, "strong").when(a < WEAK_TARGET_R, "weak")
                        .otherwise("moderate").alias("strength")).orderBy(F.col("abs_r").desc(), "feature")


def collinear_pairs(df: DataFrame, cols: Sequence[str], threshold: float = COLLINEAR_R) -> DataFrame:
    """Signed pairs with |r| above the threshold, r at 2 dp."""
    return (Q.pearson_pairs(df, cols).where(F.abs("r") > threshold)
            .select("col_a", "col_b", rnd(F.col("r"), 2).alias("r")))


def missing_ranking(basics: DataFrame) -> DataFrame:
    """Columns with any missing value, most missing first; > 40 % flagged."""
    frac = F.col("missing") / F.col("n_rows")
    return (basics.where(F.col("missing") > 0)
            .select("column", rnd(frac * 100, 2).alias("missing_pct"), (frac > HIGH_MISSING).alias("high_missing"))
            .orderBy(F.col("missing_pct").desc(), "column"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """D14 (classification): class counts, minority / majority ratio and the imbalance flag."""
    cnt = df.where(c(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(
        F.count("*").alias("count"))
    w = Window.partitionBy()  # over the class table only: one row per class
    ratio = F.min("count").over(w) / F.max("count").over(w)
    return cnt.select("class", "count", r4(ratio).alias("ratio"), (ratio < IMBALANCE_RATIO).alias("imbalanced"))


def target_skew(df: DataFrame, target: str) -> DataFrame:
    """D14 (regression): skew of the target and the > 1 flag (histogram via ``histogram``)."""
    s = P.numeric_summary(df, [target], with_shapiro=False)
    return s.select("column", F.col("skewness").alias("skew"), (F.abs("skewness") > INSIGHT_SKEW).alias("skewed"))


def describe_all(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str]) -> DataFrame:
    """Pandas ``describe(include='all')`` in long form: one row per column."""
    parts = []
    if num_cols:
        s = P.numeric_summary(df, num_cols, with_shapiro=False)
        parts.append(s.select("column", "count", "mean", "std", "min", F.col("q1").alias("p25"),
                              F.col("median").alias("p50"), F.col("q3").alias("p75"), "max"))
    if cat_cols:
        s = P.categorical_summary(df, cat_cols)
        parts.append(s.select("column", "count", F.col("unique_values").alias("unique"), F.col("top_value").alias("top"),
                              F.col("top_count").alias("freq")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def eda_insights(numeric: DataFrame | None, categorical: DataFrame | None, target_corr: DataFrame | None,
                 collinear: DataFrame | None, missing: DataFrame | None, target_dist: DataFrame | None) -> DataFrame:
    """Insight rules as ``(column, code, value)`` rows."""
    parts = []

    def hit(cond, code, value):
        return F.when(cond, F.struct(F.lit(code).alias("code"), value.cast("double").alias("value")))

    if numeric is not None:
        parts.append(numeric.select("column", F.explode(F.filter(F.array(
            hit(F.abs("skew") > INSIGHT_SKEW, "skewed", F.col("skew")),
            hit(F.col("outlier_pct") > INSIGHT_OUTLIER_PCT, "outliers", F.col("outlier_pct")),
            hit(~F.col("is_normal"), "not_normal", F.col("normality_p"))),
            lambda x: x.isNotNull())).alias("w")).select("column", "w.code", "w.value"))
    if categorical is not None:
        cat = categorical.select("column", "unique_values", "dominance").distinct()
        parts.append(cat.select("column", F.explode(F.filter(F.array(
            hit(F.col("dominance") > INSIGHT_DOMINANCE, "near_constant", F.col("dominance")),
            hit(F.col("unique_values") > INSIGHT_CARDINALITY, "high_cardinality", F.col("unique_values"))),
            lambda x: x.isNotNull())).alias("w")).select("column", "w.code", "w.value"))
    if target_corr is not None:
        parts.append(target_corr.where(F.col("strength") != "moderate").select(
            F.col("feature").alias("column"), F.concat(F.col("strength"), F.lit("_target_corr")).alias("code"),
            F.col("abs_r").alias("value")))
    if collinear is not None:
        parts.append(collinear.select(F.concat_ws("&", "col_a", "col_b").alias("column"), F.lit("collinear").alias("code"),
                                      F.col("r").alias("value")))
    if missing is not None:
        parts.append(missing.where(F.col("high_missing")).select("column", F.lit("high_missing").alias("code"),
                                                                 F.col("missing_pct").alias("value")))
    if target_dist is not None:
        parts.append(target_dist.select(F.lit(None).cast("string").alias("column"),
                                        F.when(F.col("imbalanced"), "imbalanced").otherwise("balanced").alias("code"),
                                        F.col("ratio").alias("value")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
