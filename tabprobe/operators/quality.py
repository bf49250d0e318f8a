"""Table-level quality (C1–C9) over a DataFrame and its column profile."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.columns import as_double, c, normalise_nulls, r4, rnd

# fixed thresholds of the reference's rules
PEARSON_FLAG = 0.85
WARN_DUP_PCT = 1
WARN_TOTAL_MISSING_PCT = 20
WARN_COL_MISSING_PCT = 40
WARN_OUTLIER_PCT = 15
WARN_DOMINANCE = 0.95
WARN_ZEROS_PCT = 30
WARN_CARD_RATIO = 0.9
VALIDITY_OUTLIER_PCT = 20
PAIR_BATCH = 250  # pairs per aggregation job (4 aggregates each)


def missing_overall(basics: DataFrame) -> DataFrame:
    """C1 from ``column_basics``: total missing cells and %, columns with any / all missing."""
    return basics.agg(
        F.sum("missing").alias("total_missing_cells"),
        rnd(F.try_divide(F.sum("missing") * 100.0, F.greatest(F.sum("n_rows"), F.lit(1))), 2).alias("total_missing_pct"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.count_if((F.col("missing") == F.col("n_rows")) & (F.col("n_rows") > 0)).alias("columns_all_missing"))


def co_missing_pairs(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Pairs of columns missing in the same row, most frequent first; the first ``limit`` where it is given.

    ``cols`` are the columns with any missing value (from the profile), so the
    pair count is bounded by what is actually missing; one aggregation per batch.
    """
    pairs = list(combinations(list(cols), 2))
    df, spark = normalise_nulls(df), df.sparkSession  # NaN is missing, as in the profile
    if not pairs:
        return spark.createDataFrame([], "col_a string, col_b string, co_missing_count long")
    out = None
    for i in range(0, len(pairs), PAIR_BATCH):
        batch = pairs[i:i + PAIR_BATCH]
        row = df.agg(*[F.count_if(c(a).isNull() & c(b).isNull()).alias(f"p{j}") for j, (a, b) in enumerate(batch)])
        long = row.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"p{j}").alias("co_missing_count"))
            for j, (a, b) in enumerate(batch)])))
        out = long if out is None else out.unionByName(long)
    out = out.where(F.col("co_missing_count") > 0)
    ordered = out.orderBy(F.col("co_missing_count").desc(), "col_a", "col_b")
    return ordered.limit(limit) if limit else ordered


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row on all columns (NULLs compare equal, as in pandas).

    Hot duplicate groups collapse in the map-side partial count.
    """
    g = df.groupBy(*[c(x) for x in df.columns]).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"),
                 F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(
        "duplicate_rows", rnd(F.try_divide(F.col("duplicate_rows") * 100.0, F.greatest("n", F.lit(1))), 2)
        .alias("duplicate_rows_pct"))


def duplicate_values(basics: DataFrame) -> DataFrame:
    """C4: per column n − distinct − (1 if any NULL), kept when > 0."""
    d = F.col("n_rows") - F.col("nunique") - F.when(F.col("missing") > 0, 1).otherwise(0)
    return basics.select("column", d.alias("duplicate_values")).where(F.col("duplicate_values") > 0)


def pearson_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All unordered numeric pairs with pairwise-complete Pearson r (NULL on zero variance).

    ``corr`` raises on zero variance under ANSI, so r = covar_pop / (sd_a·sd_b)
    over the rows where both are present, with a safe division.
    """
    cols = list(cols)
    pairs = list(combinations(cols, 2))
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "col_a string, col_b string, n long, r double")
    dbl = {x: as_double(df, x) for x in cols}
    out = None
    for i in range(0, len(pairs), PAIR_BATCH):
        batch = pairs[i:i + PAIR_BATCH]
        aggs = []
        for j, (a, b) in enumerate(batch):
            both = dbl[a].isNotNull() & dbl[b].isNotNull()
            aggs += [F.count_if(both).alias(f"n{j}"), F.covar_pop(dbl[a], dbl[b]).alias(f"cv{j}"),
                     F.stddev_pop(F.when(both, dbl[a])).alias(f"sa{j}"),
                     F.stddev_pop(F.when(both, dbl[b])).alias(f"sb{j}")]
        row = df.agg(*aggs)
        long = row.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"n{j}").alias("n"),
                     F.when((F.col(f"sa{j}") > 0) & (F.col(f"sb{j}") > 0),
                            F.col(f"cv{j}") / (F.col(f"sa{j}") * F.col(f"sb{j}"))).alias("r"))
            for j, (a, b) in enumerate(batch)])))
        out = long if out is None else out.unionByName(long)
    return out.withColumn("r", F.least(F.greatest(F.col("r"), F.lit(-1.0)), F.lit(1.0)))


def pearson_flags(pairs: DataFrame, threshold: float = PEARSON_FLAG) -> DataFrame:
    """Pairs with |r| above the threshold."""
    return (pairs.where(F.abs("r") > threshold)
            .select("col_a", "col_b", r4(F.col("r")).alias("pearson_r"), F.lit("high_multicollinearity").alias("flag")))


def quality_score(basics_sem: DataFrame, numeric: DataFrame | None, dups: DataFrame) -> DataFrame:
    """Completeness, uniqueness, consistency, validity, overall (1 dp) and grade."""
    cols_n = basics_sem.agg(F.count("*").alias("n_cols"), F.max("n_rows").alias("n_rows"),
                            F.sum("missing").alias("miss"),
                            F.count_if(F.col("semantic_type").isin("constant", "id")).alias("bad"))
    if numeric is not None:
        heavy = numeric.agg(F.count_if(F.col("iqr_outlier_pct") > VALIDITY_OUTLIER_PCT).alias("heavy"))
    else:
        heavy = basics_sem.sparkSession.createDataFrame([(0,)], "heavy long")
    nc, nr = F.greatest(F.col("n_cols"), F.lit(1)), F.col("n_rows")
    a, h, d = cols_n.first(), heavy.first(), dups.first()  # three one-row aggregates
    j = basics_sem.sparkSession.createDataFrame(
        [(a["n_cols"], a["n_rows"], a["miss"], a["bad"], h["heavy"], d["duplicate_rows"])],
        "n_cols long, n_rows long, miss long, bad long, heavy long, duplicate_rows long")
    comp = (1 - F.coalesce(F.try_divide(F.col("miss"), nr * F.col("n_cols")), F.lit(0.0))) * 100
    uniq = (1 - F.coalesce(F.try_divide(F.col("duplicate_rows"), nr), F.lit(0.0))) * 100
    cons = F.greatest(F.lit(0.0), (1 - F.col("bad") / nc) * 100)
    vali = F.greatest(F.lit(0.0), (1 - F.col("heavy") / nc) * 100)
    s = j.select(comp.alias("c"), uniq.alias("u"), cons.alias("k"), vali.alias("v"))
    overall = rnd((F.col("c") + F.col("u") + F.col("k") + F.col("v")) / 4, 1)
    return s.select(overall.alias("overall"), rnd("c", 1).alias("completeness"), rnd("u", 1).alias("uniqueness"),
                    rnd("k", 1).alias("consistency"), rnd("v", 1).alias("validity")).withColumn(
        "grade", F.when(F.col("overall") >= 85, "A").when(F.col("overall") >= 70, "B")
        .when(F.col("overall") >= 55, "C").otherwise("D"))


def _g(name: str, default=0):
    return F.coalesce(F.col(name), F.lit(default))


def quality_warnings(profile: DataFrame, missing: DataFrame, dups: DataFrame) -> DataFrame:
    """``(column, code, value)`` rows from the ten threshold rules (column NULL = table level)."""
    sem = F.col("semantic_type")
    rules = [
        ("constant", sem == "constant", F.lit(None).cast("double")),
        ("id_column", sem == "id", F.lit(None).cast("double")),
        ("high_missing", _g("missing_pct") > WARN_COL_MISSING_PCT, F.col("missing_pct").cast("double")),
        ("many_outliers", _g("iqr_outlier_pct") > WARN_OUTLIER_PCT, F.col("iqr_outlier_pct").cast("double")),
        ("near_constant", _g("dominance") > WARN_DOMINANCE, F.col("dominance").cast("double")),
        ("right_skewed", _g("distribution_shape", "") == "right-skewed", F.col("skewness").cast("double")),
        ("many_zeros", _g("zeros_pct") > WARN_ZEROS_PCT, F.col("zeros_pct").cast("double")),
        ("high_cardinality", (_g("cardinality_ratio") > WARN_CARD_RATIO) & (sem == "categorical"),
         F.col("unique_values").cast("double")),
    ]
    col_rows = profile.select("column", "pos", F.explode(F.filter(F.array(*[
        F.when(cond, F.struct(F.lit(i).alias("k"), F.lit(code).alias("code"), val.alias("value")))
        for i, (code, cond, val) in enumerate(rules)]), lambda x: x.isNotNull())).alias("w"))
    col_rows = col_rows.select("column", F.col("w.code").alias("code"), F.col("w.value").alias("value"))
    table = (missing.select(F.lit(None).cast("string").alias("column"), F.lit("dataset_missing").alias("code"),
                            F.col("total_missing_pct").cast("double").alias("value"))
             .where(F.col("value") > WARN_TOTAL_MISSING_PCT)
             .unionByName(dups.select(F.lit(None).cast("string").alias("column"), F.lit("duplicate_rows").alias("code"),
                                      F.col("duplicate_rows_pct").cast("double").alias("value"))
                          .where(F.col("value") > WARN_DUP_PCT)))
    return table.unionByName(col_rows)


def fe_recommendations(profile: DataFrame, target: str | None = None) -> DataFrame:
    """First matching rule per non-target column → (column, suggested_transform, priority, reason)."""
    sem, skew, neg = F.col("semantic_type"), _g("skewness"), _g("negatives_count")
    out_p, card, miss = _g("iqr_outlier_pct"), _g("cardinality_ratio"), _g("missing_pct")
    def _t(t, p, r):
        t = F.lit(t) if isinstance(t, str) else t
        p = F.lit(p) if isinstance(p, str) else p
        return F.struct(t.alias("t"), p.alias("p"), F.lit(r).alias("r"))

    t = (F.when(sem.isin("constant", "id"), _t("drop", "high", "constant_or_id"))
         .when(miss > 40, _t("drop", "high", "too_sparse"))
         .when(sem.isin("datetime", "datetime_string"), _t("cyclical", "high", "datetime"))
         .when((F.abs(skew) > 1) & (neg == 0), _t("log1p", F.when(F.abs(skew) > 2, "high").otherwise("medium"), "skewed_non_negative"))
         .when((F.abs(skew) > 1) & (neg > 0), _t("yeo_johnson", "medium", "skewed_with_negatives"))
         .when((sem == "categorical") & (card > 0.2), _t("target_encode", "medium", "high_cardinality"))
         .when(out_p > 15, _t("winsorize", "medium", "many_outliers"))
         .otherwise(_t(F.lit(None).cast("string"), "low", "no_signal")))
    p = profile if target is None else profile.where(F.col("column") != target)
    return p.select("column", t.alias("x")).select(
        "column", F.col("x.t").alias("suggested_transform"), F.col("x.p").alias("priority"), F.col("x.r").alias("reason"))


def downstream_lists(profile: DataFrame, target: str | None = None) -> DataFrame:
    """Membership flags of the six downstream lists, one row per column."""
    sem = F.col("semantic_type")
    not_t = F.lit(True) if target is None else (F.col("column") != target)
    return profile.select(
        "column",
        sem.isin("constant", "id").alias("drop_candidate"),
        ((_g("missing_pct") > 40) & not_t).alias("high_missing"),
        (F.abs(_g("skewness")) > 1).alias("skewed"),
        ((sem == "categorical") & (_g("cardinality_ratio") > 0.5)).alias("high_cardinality"),
        (sem.isin("categorical", "boolean") & not_t).alias("needs_encoding"),
        (_g("iqr_outlier_pct") > 10).alias("outlier"))
