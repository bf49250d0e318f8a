"""Statistical tests of features against the target.

Every test starts from sufficient statistics computed by Spark aggregations —
group counts, means and variances, rank sums, contingency counts — so one job
serves all features at once (long form, ``groupBy(column, ...)``). Only one row
per feature (or per feature × class) carries on to the p-value step.

Groups are ordered by class label (the reference uses order of appearance),
so the sign of t, d and U follows label order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.columns import as_double, as_label, c, r4
from tabprobe.functions.joins import bounded_broadcast
from tabprobe.functions.moments import chi2_sf_2dof, with_dagostino
from tabprobe.functions.pvalues import p_chi2, p_f, p_norm2, p_t
from tabprobe.operators import ranks
from tabprobe.operators.longform import label_long, numeric_long

# fixed values of the reference's rules
ALPHA = 0.05
MIN_GROUP = 3
MIN_PAIRS = 10
NORMALITY_MIN_N = 8
SPEARMAN_FLAG = 0.85
MI_BINS = 20
NULL_LEVEL = "__null__"
EFFECT_CUTS = {"cramers_v": (0.10, 0.30, 0.50), "eta_squared": (0.10, 0.30, 0.50),
               "epsilon_squared": (0.10, 0.30, 0.50), "cohens_d": (0.20, 0.50, 0.80),
               "pearson_r": (0.10, 0.30, 0.50), "spearman_r": (0.10, 0.30, 0.50), "point_biserial_r": (0.10, 0.30, 0.50)}


def effect_label(size: F.Column, metric: F.Column) -> F.Column:
    """Negligible / small / medium / large by the metric's cut points (on |size|)."""
    a = F.abs(size)
    out = None
    for m, (s1, s2, s3) in EFFECT_CUTS.items():
        lab = F.when(a < s1, "negligible").when(a < s2, "small").when(a < s3, "medium").otherwise("large")
        out = F.when(metric == m, lab) if out is None else out.when(metric == m, lab)
    return out.otherwise("unknown")


# ── inputs ────────────────────────────────────────────────────────────────────

def class_long(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``(column, class, value)`` over rows with a non-null target and feature."""
    d = df.withColumn("__class", as_label(df, target))
    lg = numeric_long(d, features, keep=["__class"]).withColumnRenamed("__class", "class")
    return lg.where(F.col("class").isNotNull() & F.col("value").isNotNull())


def group_summary(df: DataFrame, features: Sequence[str], target: str, min_n: int = MIN_GROUP) -> DataFrame:
    """Per feature × class n, mean, std, var for groups with ≥ ``min_n`` rows; ``n_groups`` per feature."""
    return _groups(class_long(df, features, target), min_n)


def _groups(lg: DataFrame, min_n: int = MIN_GROUP) -> DataFrame:
    g = lg.groupBy("column", "class").agg(F.count("*").alias("n"), F.avg("value").alias("mean"),
                                          F.stddev_samp("value").alias("std"), F.var_samp("value").alias("var"))
    g = g.where(F.col("n") >= min_n)
    w = Window.partitionBy("column")
    return g.withColumn("n_groups", F.count("*").over(w)).withColumn(
        "g", F.row_number().over(w.orderBy("class")))


def _anova_from_groups(g: DataFrame) -> DataFrame:
    """One-way ANOVA pieces per feature from group n / mean / var (k ≥ 2 groups)."""
    tot = g.groupBy("column").agg(F.sum("n").alias("nt"), F.count("*").alias("k"),
                                  (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("gm"))
    j = g.join(tot, "column")
    s = j.groupBy("column", "nt", "k").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("gm")) * (F.col("mean") - F.col("gm"))).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ssw"))
    s = s.where(F.col("k") >= 2)
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("nt") - F.col("k")))
    eta = F.when(F.col("ssb") + F.col("ssw") > 0, F.col("ssb") / (F.col("ssb") + F.col("ssw"))).otherwise(F.lit(0.0))
    return s.select("column", "nt", "k", f.alias("f"), (F.col("k") - 1).alias("df1"),
                    (F.col("nt") - F.col("k")).alias("df2"), eta.alias("eta_squared"))


def anova_oneway(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """E7 + E14: F statistic, degrees of freedom, eta² and p per feature."""
    a = _anova_from_groups(group_summary(df, features, target))
    return a.withColumn("p_value", p_f(F.col("f"), F.col("df1"), F.col("df2")))


def class_counts(lg: DataFrame) -> DataFrame:
    """``(column, class, value, t)``: the one table that Levene, Mann-Whitney and Kruskal-Wallis are all worked out from.

    Counted map-side, so a value that many rows share is one row for each class.
    """
    return lg.groupBy("column", "class", "value").agg(F.count("*").alias("t"))


def kept_counts(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Class counts without groups under ``MIN_GROUP`` rows, and the table of groups that stay."""
    lg = class_long(df, features, target)
    g = _groups(lg)
    return class_counts(lg).join(g.select("column", "class"), ["column", "class"], "left_semi"), g


def levene(df: DataFrame, features: Sequence[str], target: str,
           rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """Median-centred Levene F (one-way ANOVA on |x − group median|) and p per feature."""
    return levene_from(*kept_counts(df, features, target), rows_per_bucket)


def levene_from(kept: DataFrame, g: DataFrame, rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """Levene from class counts of kept groups and their ``_groups`` table.

    Sums of deviations are taken around the group's standard deviation, so no second pass and no cancellation.
    """
    keys = ["column", "class"]
    med = ranks.quantiles_from_counts(kept, [0.5], keys, rows_per_bucket=rows_per_bucket)
    centre = med.select(*keys, F.col("q").alias("med")).join(g.select(*keys, F.coalesce("std", F.lit(0.0)).alias("k")), keys)
    t, d = F.col("t"), F.abs(F.col("value") - F.col("med")) - F.col("k")
    s = kept.join(centre, keys).groupBy(*keys, "k").agg(F.sum("t").alias("n"), F.sum(t * d).alias("s1"), F.sum(t * d * d).alias("s2"))
    dev = s.select(*keys, "n", (F.col("k") + F.col("s1") / F.col("n")).alias("mean"), F.try_divide(
        F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0)), F.col("n") - 1).alias("var"))
    a = _anova_from_groups(dev)
    return a.select("column", "f", "df1", "df2", p_f(F.col("f"), F.col("df1"), F.col("df2")).alias("p_value"))


def two_group_tests(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Student and Welch t, their dof, and Cohen's d for features with exactly two groups."""
    return two_group_from(group_summary(df, features, target))


def two_group_from(g: DataFrame) -> DataFrame:
    """Two-group tests from a ``_groups`` table (no pass over the rows)."""
    g = g.where(F.col("n_groups") == 2)
    a = g.where(F.col("g") == 1).select("column", F.col("class").alias("class_1"), F.col("n").alias("n1"),
                                        F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = g.where(F.col("g") == 2).select("column", F.col("class").alias("class_2"), F.col("n").alias("n2"),
                                        F.col("mean").alias("m2"), F.col("var").alias("v2"))
    j = a.join(b, "column")
    n1, n2, m1, m2, v1, v2 = (F.col(x) for x in ("n1", "n2", "m1", "m2", "v1", "v2"))
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    t_st = F.try_divide(m1 - m2, F.sqrt(sp2 * (1.0 / n1 + 1.0 / n2)))
    se2 = v1 / n1 + v2 / n2
    t_w = F.try_divide(m1 - m2, F.sqrt(se2))
    dof_w = F.try_divide(se2 * se2, (v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1))
    pooled = F.sqrt((v1 + v2) / 2)
    d = F.when(pooled > 0, (m1 - m2) / pooled).otherwise(F.lit(0.0))
    out = j.select("column", "class_1", "class_2", "n1", "n2", t_st.alias("t_student"),
                   (n1 + n2 - 2).alias("dof_student"), t_w.alias("t_welch"), dof_w.alias("dof_welch"),
                   d.alias("cohens_d"))
    return out.withColumn("p_student", p_t(F.col("t_student"), F.col("dof_student"))).withColumn(
        "p_welch", p_t(F.col("t_welch"), F.col("dof_welch")))


def rank_sums(kept: DataFrame, rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """Rank sum ``R``, rows ``n`` and tie term ``tie`` of each feature × class, from class counts.

    Counts are ranked where they lie: sums over the values up to a row's own (its classes are peers) inside ordered buckets
    of values. Nothing is joined on a value.
    """
    size, n_groups = ranks.distinct_sizes(kept, ["column"])
    b = ranks.assign_buckets(kept, ["column"], size, rows_per_bucket)
    up_to = Window.partitionBy("column", "bucket").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    b = (b.withColumn("cum", F.sum("t").over(up_to))
         .withColumn("tv", F.sum("t").over(Window.partitionBy("column", "bucket", "value")).cast("double")))
    if ranks.bucket_count(size, rows_per_bucket) > 1:
        off = ranks.bucket_offsets(b, ["column"]).select("column", "bucket", "off")
        b = b.join(bounded_broadcast(off, n_groups * ranks.bucket_count(size, rows_per_bucket)), ["column", "bucket"])
    else:
        b = b.withColumn("off", F.lit(0))
    rank = F.col("off") + F.col("cum") - F.col("tv") + (F.col("tv") + 1) / 2.0
    # a value's t³ - t, shared out over its rows
    return b.groupBy("column", "class").agg(F.sum(F.col("t") * rank).alias("R"), F.sum("t").alias("n"),
                                            F.sum(F.col("t") * (F.col("tv") * F.col("tv") - 1)).alias("tie"))


def _rank_totals(rs: DataFrame) -> DataFrame:
    return rs.groupBy("column").agg(F.sum("tie").alias("tie"), F.sum("n").alias("nt"), F.count("*").alias("k"),
                                    F.sum(F.col("R") * F.col("R") / F.col("n")).alias("s"))


def mann_whitney(df: DataFrame, features: Sequence[str], target: str,
                 rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """U of the first group, tie- and continuity-corrected z, two-sided p (two-group features)."""
    kept, g = kept_counts(df, features, target)
    return mann_whitney_from(rank_sums(kept, rows_per_bucket), g)


def mann_whitney_from(rs: DataFrame, g: DataFrame) -> DataFrame:
    """Mann-Whitney from rank sums and the ``_groups`` table (rows per feature × class only)."""
    two = g.where(F.col("n_groups") == 2).select("column", "class", "g")
    j = rs.join(two, ["column", "class"])
    a = j.where(F.col("g") == 1).select("column", F.col("R").alias("R1"), F.col("n").alias("n1"))
    b = j.where(F.col("g") == 2).select("column", F.col("n").alias("n2"))
    j = a.join(b, "column").join(_rank_totals(rs), "column")
    n1, n2, N = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("nt").cast("double")
    u1 = F.col("R1") - n1 * (n1 + 1) / 2
    s = F.sqrt(n1 * n2 / 12 * ((N + 1) - F.col("tie") / (N * (N - 1))))
    j = j.withColumn("u", u1).withColumn("u2", n1 * n2 - u1)
    z = F.try_divide(F.greatest("u", "u2") - n1 * n2 / 2 - 0.5, s)
    return j.select("column", "n1", "n2", "u", z.alias("z")).withColumn("p_value", p_norm2(F.col("z")))


def kruskal(df: DataFrame, features: Sequence[str], target: str,
            rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """E8 + E16: tie-corrected H, dof, epsilon² and p per feature (k ≥ 2 groups)."""
    return kruskal_from(rank_sums(kept_counts(df, features, target)[0], rows_per_bucket))


def kruskal_from(rs: DataFrame) -> DataFrame:
    """Kruskal-Wallis from rank sums."""
    agg = _rank_totals(rs).where(F.col("k") >= 2)
    N = F.col("nt").cast("double")
    h0 = 12.0 / (N * (N + 1)) * F.col("s") - 3 * (N + 1)
    h = F.try_divide(h0, 1 - F.col("tie") / (N * N * N - N))
    eps = F.when(N > F.col("k"), (F.col("h") - F.col("k") + 1) / (N - F.col("k"))).otherwise(F.lit(0.0))
    out = agg.select("column", "nt", "k", h.alias("h"), (F.col("k") - 1).alias("dof"))
    return out.withColumn("epsilon_squared", eps).withColumn("p_value", p_chi2(F.col("h"), F.col("dof")))


# ── numeric feature vs numeric target ─────────────────────────────────────────

def _xy_long(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    d = df.withColumn("__y", as_double(df, target))
    lg = numeric_long(d, features, keep=["__y"]).withColumnRenamed("__y", "y")
    return lg.where(F.col("value").isNotNull() & F.col("y").isNotNull())


def _corr_agg(lg: DataFrame, x: str, y: str) -> DataFrame:
    return lg.groupBy("column").agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("cv"),
                                    F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))


def _r(cv="cv", sx="sx", sy="sy"):
    r = F.when((F.col(sx) > 0) & (F.col(sy) > 0), F.col(cv) / (F.col(sx) * F.col(sy)))
    return F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))


def _r_t(r: F.Column, n: F.Column) -> F.Column:
    return F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))


def pearson_test(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pairwise-complete Pearson r with the target, t and p (n ≥ 10)."""
    return pearson_from(_xy_long(df, features, target))


def pearson_from(xy: DataFrame) -> DataFrame:
    return pearson_from_moments(_corr_agg(xy, "value", "y"))


def pearson_from_moments(m: DataFrame) -> DataFrame:
    a = m.where(F.col("n") >= MIN_PAIRS).select("column", "n", _r().alias("r"))
    t = _r_t(F.col("r"), F.col("n"))
    return a.withColumn("t", t).withColumn(
        "p_value", F.when(F.abs("r") >= 1, F.lit(0.0)).otherwise(p_t(F.col("t"), F.col("n") - 2)))


def spearman_test(df: DataFrame, features: Sequence[str], target: str,
                  rows_per_bucket: int = ranks.ROWS_PER_BUCKET, missing: dict[str, int] | None = None) -> DataFrame:
    """Spearman rho (Pearson on average ranks over complete pairs), t and p.

    The target is ranked once for all features without NULLs (``missing`` counts them); for the others it is ranked over
    each feature's own complete pairs.
    """
    d = df.withColumn("__y", as_double(df, target)).where(F.col("__y").isNotNull())
    if missing is None:
        missing = d.agg(*[F.count_if(as_double(df, x).isNull()).alias(f"m{i}") for i, x in enumerate(features)]).first()
        missing = {x: missing[f"m{i}"] for i, x in enumerate(features)}
    full, part = [x for x in features if not missing[x]], [x for x in features if missing[x]]
    out, held = None, []
    if full:
        slim = d.select(*[as_double(df, x).alias(f"__x{i}") for i, x in enumerate(full)], "__y")
        ranked = ranks.attach_ranks(slim, "__y", [], "ry", rows_per_bucket, held=held)
        pairs = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"__x{i}").alias("value")) for i, x in enumerate(full)])
        out = _rho(ranked.select(F.inline(pairs), "ry"), rows_per_bucket)
    if part:
        lg = ranks.attach_ranks(_xy_long(df, part, target), "y", ["column"], "ry", rows_per_bucket, held=held)
        more = _rho(lg.select("column", "value", "ry"), rows_per_bucket)
        out = more if out is None else out.unionByName(more)
    for vc in held:
        vc.unpersist()
    t = _r_t(F.col("rho"), F.col("n"))
    return out.where(F.col("n") >= MIN_PAIRS).withColumn("t", t).withColumn(
        "p_value", F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(p_t(F.col("t"), F.col("n") - 2)))


def _rho(rows: DataFrame, rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """``(column, n, rho)`` from rows ``(column, value, ry)``, ``ry`` being the other side's rank.

    Rows are summed by value, so the ranks of ``value`` meet sums over distinct values and never rows:
    sum(rx * ry) = sum over values of rx * (sum of ry of its rows). Ranks are taken less their mean (n + 1) / 2.
    The sums by value are persisted, to be counted, cut into buckets and ranked; the result reads them, so they stay.
    """

    vc = rows.groupBy("column", "value").agg(F.count("*").alias("t"), F.sum("ry").alias("sy"), F.sum(F.col("ry") * F.col("ry")).alias("syy")).persist(StorageLevel.MEMORY_AND_DISK)
    size, n_groups = ranks.distinct_sizes(vc, ["column"])
    r = ranks.with_positions(vc, ["column"], (size, n_groups), rows_per_bucket)
    mid = (F.col("n") + 1) / 2.0
    dx, sy = F.col("avg_rank") - mid, F.col("sy") - F.col("t") * mid
    a = r.groupBy("column", "n").agg(F.sum(dx * sy).alias("cv"), F.sum(F.col("t") * dx * dx).alias("vx"), F.sum("syy").alias("syy"))
    n = F.col("n").cast("double")
    vy = F.col("syy") - n * ((n + 1) / 2) * ((n + 1) / 2)
    rho = F.when((F.col("vx") > 0) & (vy > 0.25), F.col("cv") / F.sqrt(F.col("vx") * vy))
    return a.select("column", "n", F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0)).alias("rho"))


def point_biserial(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Two-valued feature vs numeric target: r of (x = max x) with y, t and p."""
    lg = _xy_long(df, features, target)
    mx = lg.groupBy("column").agg(F.max("value").alias("mx"), F.countDistinct("value").alias("u"))
    j = lg.join(bounded_broadcast(mx.where(F.col("u") == 2), len(features)), "column").withColumn(
        "e", (F.col("value") == F.col("mx")).cast("double"))
    a = _corr_agg(j, "e", "y").select("column", "n", _r().alias("r"))
    return a.withColumn("t", _r_t(F.col("r"), F.col("n"))).withColumn(
        "p_value", F.when(F.abs("r") >= 1, F.lit(0.0)).otherwise(p_t(F.col("t"), F.col("n") - 2)))


def spearman_collinearity(df: DataFrame, cols: Sequence[str], threshold: float = SPEARMAN_FLAG,
                          rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """Numeric pairs with |rho| > threshold over ≥ 10 complete rows.

    Each column without NULLs is ranked once and all their pairs are correlated in one
    aggregation. Pairs with NULLs are re-ranked over their own complete rows, as pairwise
    deletion requires, all of them in one long form.
    """
    from tabprobe.operators import quality as Q
    from tabprobe.operators.profile import _freeze
    cols = list(cols)
    nulls = df.agg(*[F.count_if(as_double(df, x).isNull()).alias(f"m{i}") for i, x in enumerate(cols)]).first()
    nulls = {x: nulls[f"m{i}"] for i, x in enumerate(cols)}
    full = [x for x in cols if nulls[x] == 0]
    ranked = df.select(*[as_double(df, x).alias(f"v{i}") for i, x in enumerate(cols)])
    pairs, held = None, []
    if len(full) > 1:
        base = ranked
        for x in full:
            i = cols.index(x)
            ranked = ranks.attach_ranks(ranked, f"v{i}", [], f"r{i}", rows_per_bucket, source=base, held=held)
        name = F.create_map(*[F.lit(v) for i, x in enumerate(cols) for v in (f"r{i}", x)])
        pairs = _freeze(Q.pearson_pairs(ranked, [f"r{cols.index(x)}" for x in full]).select(
            name[F.col("col_a")].alias("col_a"), name[F.col("col_b")].alias("col_b"), "n", F.col("r").alias("rho")))  # a row a pair
    holes = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols)) if nulls[cols[i]] or nulls[cols[j]]]
    if holes:  # all pairs with NULLs at once: a pair is a group of the long form
        one = F.array(*[F.struct(F.lit(f"{i},{j}").alias("column"), F.col(f"v{i}").alias("value"), F.col(f"v{j}").alias("y")) for i, j in holes])
        lg = df.select(*[as_double(df, x).alias(f"v{i}") for i, x in enumerate(cols)]).select(F.inline(one)).where(F.col("value").isNotNull() & F.col("y").isNotNull())
        lg = ranks.attach_ranks(lg, "y", ["column"], "ry", rows_per_bucket, held=held).select("column", "value", "ry")
        names = F.array(*[F.lit(x) for x in cols])
        at = F.split("column", ",")
        more = _rho(lg, rows_per_bucket).select(names[at[0].cast("int")].alias("col_a"), names[at[1].cast("int")].alias("col_b"), "n", "rho")
        pairs = more if pairs is None else pairs.unionByName(more)
    for vc in held:
        vc.unpersist()
    if pairs is None:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, n long, rho double")
    return pairs.where((F.col("n") >= MIN_PAIRS) & (F.abs("rho") > threshold)).select(
        "col_a", "col_b", "n", "rho")


# ── categorical feature vs class target ───────────────────────────────────────

def contingency(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``(column, level, class, observed)`` for the cells that have rows; absent cells are 0."""
    d = df.withColumn("__class", as_label(df, target))
    lg = label_long(d, features, keep=["__class"]).withColumnRenamed("__class", "class")
    lg = lg.where(F.col("class").isNotNull() & F.col("value").isNotNull()).withColumnRenamed("value", "level")
    return lg.groupBy("column", "level", "class").agg(F.count("*").alias("observed"))


def chi_square(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """E12 + E13: chi² (Yates when dof = 1), dof, % expected < 5, assumption flag, Cramér's V, p."""
    from tabprobe.operators.profile import _freeze
    obs = contingency(df, features, target).persist(StorageLevel.MEMORY_AND_DISK)  # margins, levels and sizes are all taken from it
    out = _freeze(chi_square_from(obs))  # a row a feature
    obs.unpersist()
    return out


def chi_square_from(obs: DataFrame) -> DataFrame:
    """Chi² from the cells that have rows: n (Σ o² / (r c) − 1), without the grid of all levels × classes.

    Cells are summed to one row a level after meeting their class's margin. Expected counts under 5 are counted for absent
    cells too, by a running count over the sorted margins: r c / n < 5 holds for the levels with r < 5 n / c.
    """
    by_class = Window.partitionBy("column").orderBy("class")
    margins = obs.groupBy("column", "class").agg(F.sum("observed").alias("cj"))
    margins = margins.withColumn("first", F.row_number().over(by_class) == 1)
    o = F.col("observed").cast("double")
    levels = obs.join(margins, ["column", "class"]).groupBy("column", "level").agg(
        F.sum("observed").alias("r"), F.sum(o * o / F.col("cj")).alias("s"), F.sum(F.when(F.col("first"), F.col("observed")).otherwise(0)).alias("a"))
    of_levels = levels.groupBy("column").agg(
        F.sum("r").alias("nt"), F.count("*").alias("r"), F.sum(F.col("s") / F.col("r")).alias("q"), F.sum(1.0 / F.col("r")).alias("ir"),
        F.sum("a").alias("c1"), F.max(F.struct("level", "a", "r")).alias("one"))
    of_classes = margins.groupBy("column").agg(F.count("*").alias("k"), F.sum(1.0 / F.col("cj")).alias("ic"))
    shape = of_levels.join(of_classes, "column").where((F.col("r") >= 2) & (F.col("k") >= 2)).withColumn("dof", (F.col("r") - 1) * (F.col("k") - 1))
    # how many levels are small against each class: levels of one margin are one row
    under = F.ceil(F.lit(5.0) * F.col("nt") / F.col("cj")).cast("long")
    marks = margins.join(shape.select("column", "nt"), "column").select("column", under.alias("at"), F.lit(0).cast("long").alias("m"), F.lit(1).alias("asks"))
    sizes = levels.groupBy("column", F.col("r").alias("at")).agg(F.count("*").alias("m")).withColumn("asks", F.lit(0))
    before = Window.partitionBy("column").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    low = sizes.select("column", "at", "m", "asks").unionByName(marks).withColumn("low", F.coalesce(F.sum("m").over(before), F.lit(0)))
    low = low.where(F.col("asks") == 1).groupBy("column").agg(F.sum("low").alias("cells"))
    j = shape.join(low, "column")
    n = F.col("nt").cast("double")
    plain = F.greatest(n * (F.col("q") - 1), F.lit(0.0))
    # 2 x 2: every cell is off by the same amount
    off = F.abs(F.col("one.a") - F.col("one.r") * F.col("c1") / n)
    adj = off - F.least(F.lit(0.5), off)
    chi2 = F.when(F.col("dof") == 1, adj * adj * n * F.col("ir") * F.col("ic")).otherwise(plain)
    share = F.col("cells") / (F.col("r") * F.col("k"))
    mk = F.least("r", "k")
    v = F.when(mk > 1, F.sqrt(F.col("statistic") / (F.col("nt") * (mk - 1)))).otherwise(F.lit(0.0))
    return j.withColumn("statistic", chi2).select(
        "column", "statistic", F.col("dof").cast("long").alias("dof"), (share * 100).alias("pct_cells_low_expected"),
        (share < 0.20).alias("expected_freq_assumption_ok"), v.alias("cramers_v"), "r", "k").withColumn("p_value", p_chi2(F.col("statistic"), F.col("dof")))


def category_vs_numeric(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    """E7/E8 with the roles swapped (categorical feature, numeric target): ANOVA and Kruskal tables.

    The target is grouped by each feature's levels: ``(column=feature, class=level, value=y)``.
    """
    d = df.withColumn("__y", as_double(df, target))
    lg = label_long(d, features, keep=["__y"]).where(F.col("value").isNotNull() & F.col("__y").isNotNull())
    lg = lg.select("column", F.col("value").alias("class"), F.col("__y").alias("value"))
    g = _groups(lg)
    kept = class_counts(lg).join(g.select("column", "class"), ["column", "class"], "left_semi")
    return _anova_p(g), kruskal_from(rank_sums(kept))


def _anova_p(g: DataFrame) -> DataFrame:
    return _anova_from_groups(g).withColumn("p_value", p_f(F.col("f"), F.col("df1"), F.col("df2")))


# ── FDR, mutual information, ranking ──────────────────────────────────────────

def bh_fdr(tests: DataFrame, p_col: str = "p_value", alpha: float = ALPHA) -> DataFrame:
    """Benjamini-Hochberg adjusted p and reject flag over a per-feature table (one row per feature)."""
    t = tests.where(F.col(p_col).isNotNull())
    w = Window.orderBy(F.col(p_col), F.col("feature"))  # per-feature table: one small partition is fine
    t = t.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy()))
    t = t.withColumn("__adj", F.least(F.lit(1.0), F.col(p_col) * F.col("__n") / F.col("__k")))
    rev = Window.orderBy(F.col("__k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("p_adjusted", F.min("__adj").over(rev))
    crit = F.col(p_col) <= F.col("__k") / F.col("__n") * alpha
    t = t.withColumn("__kmax", F.max(F.when(crit, F.col("__k"))).over(Window.partitionBy()))
    t = t.withColumn("significant_after_fdr", F.coalesce(F.col("__k") <= F.col("__kmax"), F.lit(False)))
    return t.drop("__k", "__n", "__adj", "__kmax")


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int, rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> dict[str, list[tuple[float, int]]]:
    """Equal-frequency bins of each column: (smallest value, bin) in order; the bin is floor(rank start · bins / n).

    At most ``bins`` pairs a column reach the driver.
    """
    if not cols:
        return {}
    lg = numeric_long(df, cols)
    rt = ranks.rank_table(lg, ["column"], rows_per_bucket=rows_per_bucket)
    e = rt.groupBy("column", F.floor(F.col("start") * bins / F.col("n")).alias("bin")).agg(F.min("value").alias("lo")).collect()
    return {x: sorted((r["lo"], r["bin"]) for r in e if r["column"] == x) for x in cols}


def bin_of(value: F.Column, edges: list[tuple[float, int]]) -> F.Column:
    """The bin whose range holds ``value`` as a label; NULL → −1. A few comparisons a row, and no join."""
    if not edges:
        return F.lit("-1")
    at = F.size(F.filter(F.array(*[F.lit(float(lo)) for lo, _ in edges]), lambda lo: lo <= value))
    return F.when(value.isNull(), F.lit("-1")).otherwise(F.array(*[F.lit(str(b)) for _, b in edges])[at - 1])


def mutual_information(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str,
                       problem_type: str = "classification", bins: int = MI_BINS,
                       rows_per_bucket: int = ranks.ROWS_PER_BUCKET) -> DataFrame:
    """Plug-in MI (nats) of each feature with the target.

    Numeric sides are cut into ``bins`` equal-frequency bins (ties share a bin),
    categories are used as they are, NULL is its own level. One
    ``groupBy(column, x, y)`` serves all features.
    """
    from tabprobe.operators.profile import _freeze
    if problem_type == "classification":
        d = df.withColumn("__y", as_label(df, target)).where(F.col("__y").isNotNull())
        edges = bin_edges(d, numeric, bins, rows_per_bucket)
    else:
        d = df.where(as_double(df, target).isNotNull())
        edges = bin_edges(d, [target, *(x for x in numeric if x != target)], bins, rows_per_bucket)
        d = d.withColumn("__y", bin_of(as_double(df, target), edges[target]))
    sides = [(x, bin_of(as_double(df, x), edges[x])) for x in numeric]
    sides += [(x, F.coalesce(as_label(df, x), F.lit(NULL_LEVEL))) for x in categorical]
    lg = d.select("__y", F.inline(F.array(*[F.struct(F.lit(x).alias("column"), xb.cast("string").alias("xb")) for x, xb in sides])))
    xy = lg.groupBy("column", "xb", "__y").agg(F.count("*").alias("nxy")).persist(StorageLevel.MEMORY_AND_DISK)  # read for both margins too
    nx = xy.groupBy("column", "xb").agg(F.sum("nxy").alias("nx"))
    ny = xy.groupBy("column", "__y").agg(F.sum("nxy").alias("ny"))
    n = xy.groupBy("column").agg(F.sum("nxy").alias("n"))
    j = xy.join(nx, ["column", "xb"]).join(ny, ["column", "__y"]).join(n, "column")
    pxy = F.col("nxy") / F.col("n")
    term = pxy * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    out = _freeze(j.groupBy("column").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi")))
    xy.unpersist()
    return out


def rank_features(tests: DataFrame, mi: DataFrame | None) -> DataFrame:
    """combined = max(effect, MI / max MI); FDR-significant first, then combined, then name."""
    t = tests if mi is None else tests.join(mi.select(F.col("column").alias("feature"), F.col("mi").alias("mi_score")),
                                            "feature", "left")
    if mi is None:
        t = t.withColumn("mi_score", F.lit(None).cast("double"))
    mx = F.max("mi_score").over(Window.partitionBy())  # per-feature table
    mx = F.when(F.coalesce(mx, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(mx)
    comb = F.greatest(F.coalesce("effect_size", F.lit(0.0)), F.coalesce("mi_score", F.lit(0.0)) / mx)
    t = t.withColumn("combined_score", r4(comb)).withColumn("significant", F.coalesce(F.col("p_value") < ALPHA, F.lit(False)))
    w = Window.orderBy(F.col("significant_after_fdr").desc(), F.col("combined_score").desc(), F.col("feature"))
    return t.withColumn("rank", F.row_number().over(w).cast("long"))


def fe_signals(ranked: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Per-feature flags: high MI, low MI and insignificant, non-linear, strong, target-encoding."""
    mi = F.coalesce("mi_score", F.lit(0.0))
    is_r = F.col("test").isin("pearson", "spearman")
    lab = F.coalesce("effect_label", F.lit("negligible"))
    return ranked.select(
        "feature", (mi > 0.05).alias("high_mi"),
        ((mi < 0.01) & (F.coalesce("p_value", F.lit(1.0)) > ALPHA)).alias("low_mi_insignificant"),
        (((mi > 0.05) & is_r & (F.abs(F.coalesce("statistic", F.lit(0.0))) < 0.2))
         | ((mi > 0.05) & ~is_r & lab.isin("negligible", "small"))).alias("nonlinear"),
        ((lab == "large") & (mi > 0.1)).alias("strong"),
        (F.col("feature").isin(*categorical) & (mi > 0.05)).alias("target_encoding") if categorical
        else F.lit(False).alias("target_encoding"))


def significance_buckets(ranked: DataFrame) -> DataFrame:
    """Bucket flags per feature (significant, after FDR, effect bucket) plus warning codes."""
    lab = F.col("effect_label")
    return ranked.select(
        "feature", "significant", "significant_after_fdr",
        F.when(lab == "large", "large").when(lab == "medium", "medium").otherwise("small").alias("effect_bucket"),
        (F.col("significant") & (lab == "negligible")).alias("warn_negligible_but_significant"),
        (F.coalesce(F.col("expected_freq_assumption_ok"), F.lit(True)) == F.lit(False)).alias("warn_low_expected"))


#: More features than this losing significance is worth a warning (fixed value of the reference's rules).
MOST_LOST = 3


def stats_warnings(ranked: DataFrame, signals: DataFrame, collinear: DataFrame | None = None) -> DataFrame:
    """``code, feature, other, value``, a row a warning.

    ``none_significant``; ``lost_after_fdr`` (value: how many, over ``MOST_LOST``); ``nonlinear`` (high information, little
    linear effect); ``low_expected`` (value: % of cells with expected counts under 5); ``negligible_but_significant``;
    ``collinear`` (value: Spearman's rho of the pair). ``ranked`` is from ``rank_features``, ``signals`` from
    ``fe_signals``, ``collinear`` from ``spearman_collinearity``. Counts over no features are 0, so an empty table warns once.
    """
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, code: str, feature: F.Column = none, other: F.Column = none, value: F.Column | None = None) -> DataFrame:
        number = F.lit(None) if value is None else value
        return df.select(F.lit(code).alias("code"), feature.alias("feature"), other.alias("other"), number.cast("double").alias("value"))

    name = F.col("feature")
    total = ranked.agg(F.count_if("significant").alias("s"), F.count_if(F.coalesce("significant_after_fdr", F.lit(False))).alias("f"))
    lost = F.col("s") - F.col("f")
    parts = [rows(total.where(F.col("s") == 0), "none_significant"),
             rows(total.where(lost > MOST_LOST), "lost_after_fdr", value=lost),
             rows(signals.where("nonlinear"), "nonlinear", name),
             rows(ranked.where(F.col("expected_freq_assumption_ok") == F.lit(False)), "low_expected", name, value=F.col("pct_cells_low_expected")),
             rows(ranked.where((F.col("effect_label") == "negligible") & (F.col("p_value") < ALPHA)), "negligible_but_significant", name)]
    if collinear is not None:
        parts.append(rows(collinear, "collinear", F.col("col_a"), F.col("col_b"), F.col("rho")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ── E2 + E25: normality gate and the per-feature router ───────────────────────

def normality_gate(lg: DataFrame, group_cols: Sequence[str], shapiro_sample: int | None = None) -> DataFrame:
    """A group passes with n ≥ 8 and a normality p > α; all groups of a column must pass.

    The test is D'Agostino-Pearson K² on the moments of all rows (one aggregation). With ``shapiro_sample`` it is
    Shapiro-Wilk on that many rows a group, the reference's rule (500).
    """
    g = list(group_cols)
    if shapiro_sample is None:
        m = lg.groupBy(*g).agg(F.count("value").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
        tested = with_dagostino(m).withColumn("p", chi2_sf_2dof(F.col("k2")))
    else:
        from tabprobe.operators.profile import shapiro_by_group
        n = lg.groupBy(*g).agg(F.count("value").alias("n"))
        tested = n.join(shapiro_by_group(lg, g, shapiro_sample).withColumnRenamed("sw_p", "p"), g, "left")
    ok = tested.withColumn("ok", (F.col("n") >= NORMALITY_MIN_N) & F.coalesce(
        ~F.isnan("p") & (F.col("p") > ALPHA), F.lit(False)))
    return ok.groupBy("column").agg(F.bool_and("ok").alias("normal"))


_RANK_SUMS = "column string, class string, R double, n long, tie double"


def _gated(lg: DataFrame, frozen: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, the gates ``(column, normal, eqv)`` and the persisted class counts of kept groups, from long rows.

    Group moments and the normality gate are one map-side aggregation of the rows. The groups are collected only if there
    are few for sure (``frozen``: features × classes).
    """
    from tabprobe.operators.profile import _freeze

    m = lg.groupBy("column", "class").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("var"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")).where(F.col("n") >= MIN_GROUP)
    m = _freeze(m) if frozen else m.persist(StorageLevel.MEMORY_AND_DISK)
    w = Window.partitionBy("column")
    g = m.withColumn("n_groups", F.count("*").over(w)).withColumn("g", F.row_number().over(w.orderBy("class")))
    normal = _with_gate(m, "ok").groupBy("column").agg(F.bool_and("ok").alias("normal"))
    kept = class_counts(lg).join(m.select("column", "class"), ["column", "class"], "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    lev = levene_from(kept, m).select("column", F.coalesce(F.col("p_value") > ALPHA, F.lit(False)).alias("eqv"))
    return g, _freeze(normal.join(lev, "column", "left")), kept


def _with_gate(m: DataFrame, out: str, n: str = "n", g1: str = "g1", g2: str = "g2") -> DataFrame:
    """Adds ``out``: n ≥ 8 and K² of the skewness and excess kurtosis is not significant."""
    p = chi2_sf_2dof(F.col("gate_k2"))
    ok = (F.col(n) >= NORMALITY_MIN_N) & F.coalesce(~F.isnan(p) & (p > ALPHA), F.lit(False))
    return with_dagostino(m, g1, g2, n, "gate_k2").withColumn(out, ok).drop("gate_k2")


def _pair_moments(xy: DataFrame) -> DataFrame:
    """Size, co-moments and shape of both sides of each feature's complete pairs: one pass, combined map-side."""
    return xy.groupBy("column").agg(
        F.count("*").alias("n"), F.covar_pop("value", "y").alias("cv"), F.stddev_pop("value").alias("sx"), F.stddev_pop("y").alias("sy"),
        F.skewness("value").alias("x_g1"), F.kurtosis("value").alias("x_g2"), F.skewness("y").alias("y_g1"), F.kurtosis("y").alias("y_g2"))


_OUT = "feature string, test string, statistic double, p_value double, effect_size double, effect_metric string, " \
       "n_groups long, normality_assumption boolean, equal_variance_assumption boolean, " \
       "expected_freq_assumption_ok boolean, pct_cells_low_expected double, skipped string"


def _rows(df: DataFrame, **cols) -> DataFrame:
    base = {f.split()[0]: f.split()[1] for f in _OUT.split(", ")}
    return df.select(*[(cols[k] if k in cols else F.lit(None)).cast(t).alias(k) for k, t in base.items()])


def router_info(df: DataFrame, feats: Sequence[str]) -> dict:
    """Per feature: kind, missing count and ``nunique`` capped at 3 (0, 1, 2 or 3 = "more than two").

    Two global aggregations without a shuffle: count / min / max, then the count of
    values strictly between min and max (zero ⇔ at most two distinct values).
    """
    from tabprobe.operators.profile import column_kind
    kinds_ = {x: column_kind(df.schema[x].dataType) for x in feats}
    cols = [x for x in feats if kinds_[x] in ("numeric", "string", "datetime")]

    def val(x):
        return as_double(df, x) if kinds_[x] == "numeric" else c(x)

    out = {x: {"kind": kinds_[x], "nunique": None, "missing": None} for x in feats}
    if not cols:
        return out
    a = df.agg(F.count(F.lit(1)).alias("__n"), *[f(val(x)).alias(f"{p}{i}") for i, x in enumerate(cols)
                                                  for p, f in (("c", F.count), ("lo", F.min), ("hi", F.max))]).first()
    mids = {x: i for i, x in enumerate(cols) if a[f"c{i}"] and a[f"lo{i}"] != a[f"hi{i}"]}
    b = df.agg(*[F.count_if((val(x) > F.lit(a[f"lo{i}"])) & (val(x) < F.lit(a[f"hi{i}"]))).alias(f"m{i}")
                 for x, i in mids.items()]).first() if mids else None
    for i, x in enumerate(cols):
        n = a[f"c{i}"]
        u = 0 if n == 0 else 1 if x not in mids else (2 if b[f"m{i}"] == 0 else 3)
        out[x] = {"kind": kinds_[x], "nunique": u, "missing": a["__n"] - n}
    return out


def test_features(df: DataFrame, target: str, problem_type: str = "classification",
                  features: Sequence[str] | None = None) -> DataFrame:
    """One row per feature with the test the reference's rules pick, its statistic, p and effect.

    Skipped features keep a reason (constant_or_all_missing, unsupported_dtype,
    insufficient_groups, insufficient_data, insufficient_categories). BH
    adjustment (E20) and the effect label (E17) are added at the end.
    """
    from tabprobe.operators.profile import _freeze

    spark = df.sparkSession
    feats = [x for x in (features or df.columns) if x != target]
    info = router_info(df, feats)
    parts, skipped = [], []
    num, cat = [], []
    for x in feats:
        r = info[x]
        if r["nunique"] is not None and r["nunique"] <= 1:
            skipped.append((x, "constant_or_all_missing"))
        elif r["kind"] == "numeric":
            num.append(x)
        elif r["kind"] == "string":
            cat.append(x)
        else:
            skipped.append((x, "unsupported_dtype"))
    if problem_type == "classification":
        if num:
            # one table of class counts, persisted: medians, ranks and ties are all taken from it
            lg = class_long(df, num, target)
            g, gate, kept = _gated(lg)
            base = _freeze(g.groupBy("column").agg(F.max("n_groups").alias("n_groups")).join(gate, "column", "left"))
            chosen = {r["column"]: (r["n_groups"], bool(r["normal"]), bool(r["eqv"])) for r in base.collect()}
            ranked = [x for x, (k, nm, ev) in chosen.items() if k >= 2 and not (nm and (ev or k == 2))]
            rs = _freeze(rank_sums(kept.where(F.col("column").isin(*ranked)))) if ranked else spark.createDataFrame([], _RANK_SUMS)
            kept.unpersist()
            two, an = two_group_from(g), _anova_p(g)
            mw, kw = mann_whitney_from(rs, g), kruskal_from(rs)
            j = (base.join(two.select("column", "t_student", "p_student", "t_welch", "p_welch", "cohens_d"), "column", "left")
                 .join(mw.select("column", F.col("u").alias("u_mw"), F.col("p_value").alias("p_mw")), "column", "left")
                 .join(an.select("column", "f", F.col("p_value").alias("p_an"), "eta_squared"), "column", "left")
                 .join(kw.select("column", "h", F.col("p_value").alias("p_kw"), "epsilon_squared"), "column", "left"))
            normal, eqv, k = F.coalesce("normal", F.lit(False)), F.col("eqv"), F.col("n_groups")
            test = (F.when(k < 2, None).when((k == 2) & normal & eqv, "students_t").when((k == 2) & normal, "welch_t")
                    .when(k == 2, "mann_whitney_u").when(normal & eqv, "anova").otherwise("kruskal_wallis"))
            j = j.withColumn("test", test)
            pick = lambda a, b, c_, d, e: (F.when(F.col("test") == "students_t", a).when(F.col("test") == "welch_t", b)
                                           .when(F.col("test") == "mann_whitney_u", c_).when(F.col("test") == "anova", d)
                                           .otherwise(e))
            metric = F.when(k == 2, "cohens_d").when(F.col("test") == "anova", "eta_squared").otherwise("epsilon_squared")
            parts.append(_rows(
                j, feature=F.col("column"), test=F.col("test"),
                statistic=pick(F.col("t_student"), F.col("t_welch"), F.col("u_mw"), F.col("f"), F.col("h")),
                p_value=pick(F.col("p_student"), F.col("p_welch"), F.col("p_mw"), F.col("p_an"), F.col("p_kw")),
                effect_size=F.when(k == 2, F.col("cohens_d")).when(F.col("test") == "anova", F.col("eta_squared"))
                .otherwise(F.col("epsilon_squared")),
                effect_metric=metric, n_groups=k, normality_assumption=normal, equal_variance_assumption=eqv,
                skipped=F.when(k < 2, "insufficient_groups")))
        if cat:
            ch = _freeze(chi_square(df, cat, target))  # a row a feature
            parts.append(_rows(ch, feature=F.col("column"), test=F.lit("chi_square"), statistic=F.col("statistic"),
                               p_value=F.col("p_value"), effect_size=F.col("cramers_v"), effect_metric=F.lit("cramers_v"),
                               expected_freq_assumption_ok=F.col("expected_freq_assumption_ok"),
                               pct_cells_low_expected=F.col("pct_cells_low_expected")))
            done = ch.select(F.col("column").alias("feature"))
            allc = spark.createDataFrame([(x,) for x in cat], "feature string")
            parts.append(_rows(allc.join(done, "feature", "left_anti"), feature=F.col("feature"),
                               skipped=F.lit("insufficient_categories")))
    else:
        binary = [x for x in num if info[x]["nunique"] == 2]
        rest = [x for x in num if x not in binary]
        if binary:
            pb = point_biserial(df, binary, target)
            parts.append(_rows(pb, feature=F.col("column"), test=F.lit("point_biserial"), statistic=F.col("r"),
                               p_value=F.col("p_value"), effect_size=F.abs("r"), effect_metric=F.lit("point_biserial_r")))
        if rest:
            d = df.withColumn("__y", as_double(df, target)).where(F.col("__y").isNotNull())
            missing = {x: info[x]["missing"] or 0 for x in rest}
            m = _freeze(_pair_moments(_xy_long(df, rest, target)))  # a row a feature: r and both gates in one pass
            pe = pearson_from_moments(m).select("column", "r", F.col("p_value").alias("pp"))
            sp = spearman_test(d, rest, target, missing=missing).select("column", "rho", F.col("p_value").alias("ps"))
            gates = _with_gate(_with_gate(m, "xn", "n", "x_g1", "x_g2"), "yn", "n", "y_g1", "y_g2").select("column", "xn", "yn")
            j = _freeze(pe.join(sp, "column").join(gates, "column", "left"))
            both = F.coalesce(F.col("xn"), F.lit(False)) & F.coalesce(F.col("yn"), F.lit(False))
            stat = F.when(both, F.col("r")).otherwise(F.col("rho"))
            parts.append(_rows(j, feature=F.col("column"), test=F.when(both, "pearson").otherwise("spearman"),
                               statistic=stat, p_value=F.when(both, F.col("pp")).otherwise(F.col("ps")),
                               effect_size=F.abs(stat), effect_metric=F.when(both, "pearson_r").otherwise("spearman_r"),
                               normality_assumption=both))
            allr = spark.createDataFrame([(x,) for x in rest], "feature string")
            parts.append(_rows(allr.join(j.select(F.col("column").alias("feature")), "feature", "left_anti"),
                               feature=F.col("feature"), skipped=F.lit("insufficient_data")))
        if cat:
            d = df.withColumn("__y", as_double(df, target))
            lg = label_long(d, cat, keep=["__y"]).where(F.col("value").isNotNull() & F.col("__y").isNotNull())
            g, gate, kept = _gated(lg.select("column", F.col("value").alias("class"), F.col("__y").alias("value")), frozen=False)
            a, kw = _anova_p(g), kruskal_from(rank_sums(kept))
            ng = g.groupBy("column").agg(F.max("n_groups").alias("n_groups"))
            j = (ng.join(gate, "column", "left").join(a.select("column", "f", F.col("p_value").alias("pa"), "eta_squared"), "column", "left")
                 .join(kw.select("column", "h", F.col("p_value").alias("pk"), "epsilon_squared"), "column", "left"))
            j = _freeze(j)  # a row a feature
            kept.unpersist()
            use_a = F.coalesce("normal", F.lit(False)) & F.coalesce("eqv", F.lit(False))
            parts.append(_rows(j, feature=F.col("column"), test=F.when(F.col("n_groups") < 2, None).when(use_a, "anova").otherwise("kruskal_wallis"),
                               statistic=F.when(use_a, F.col("f")).otherwise(F.col("h")),
                               p_value=F.when(use_a, F.col("pa")).otherwise(F.col("pk")),
                               effect_size=F.when(use_a, F.col("eta_squared")).otherwise(F.col("epsilon_squared")),
                               effect_metric=F.when(use_a, "eta_squared").otherwise("epsilon_squared"),
                               n_groups=F.col("n_groups"), normality_assumption=F.coalesce("normal", F.lit(False)),
                               equal_variance_assumption=F.coalesce("eqv", F.lit(False)),
                               skipped=F.when(F.col("n_groups") < 2, "insufficient_groups")))
    if skipped:
        parts.append(_rows(spark.createDataFrame(skipped, "feature string, skipped string"),
                           feature=F.col("feature"), skipped=F.col("skipped")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("effect_label", F.when(F.col("skipped").isNull(), effect_label(F.col("effect_size"), F.col("effect_metric"))))
    tested = bh_fdr(out.where(F.col("skipped").isNull()))
    rest = out.where(F.col("skipped").isNotNull()).withColumn("p_adjusted", F.lit(None).cast("double")).withColumn(
        "significant_after_fdr", F.lit(False))
    return tested.unionByName(rest)
