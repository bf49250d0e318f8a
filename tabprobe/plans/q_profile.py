"""Registered queries for the column profile (B) and table quality (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.operators import profile as P
from tabprobe.operators import quality as Q
from tabprobe.operators import sketches as K
from tabprobe.plans.registry import register
from tabprobe.plans.sqlgen import dbl, lit, per_column, profile_ctes, qi
from tabprobe.sources.tables import fixture, fixture_cte, table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SHAPES_NUM = ["user_id", "two_valued", "skewed", "skewed_neg"]
SHAPES_COLS = [("event_id", "numeric"), ("const_col", "numeric"), ("flag", "numeric"), ("two_valued", "numeric"),
               ("user_id", "numeric"), ("event_type", "string"), ("ts", "datetime"), ("skewed", "numeric"),
               ("skewed_neg", "numeric")]
NULLS_COLS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
              ("o_orderdate", "datetime"), ("o_totalprice", "numeric"), ("o_orderpriority", "string")]
STATUS_CAT = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]


def _shapes_profile(spark, sf):
    return P.profile_columns(fixture(spark, sf, "fx_shapes"), with_shapiro=False)


def _nulls_profile(spark, sf):
    return P.profile_columns(fixture(spark, sf, "fx_nulls"), with_shapiro=False)


# ── B1–B3 ─────────────────────────────────────────────────────────────────────

def _sem_sql(src, cols):
    return profile_ctes(src, cols)


@register("b1_semantic_types", fixture_cte("fx_shapes") + ", " + _sem_sql("fx_shapes", SHAPES_COLS) +
          '\nSELECT col AS "column", semantic_type FROM sem')
def b1_semantic_types(spark, sf):
    return P.semantic_types(fixture(spark, sf, "fx_shapes")).select("column", "semantic_type")


@register("b2_missing_per_column", fixture_cte("fx_nulls") + ", " + _sem_sql("fx_nulls", NULLS_COLS) +
          '\nSELECT col AS "column", n_rows - n AS missing_count, missing_pct FROM sem2')
def b2_missing_per_column(spark, sf):
    s = P.semantic_types(fixture(spark, sf, "fx_nulls"))
    return s.select("column", F.col("missing").alias("missing_count"), "missing_pct")


@register("b3_cardinality", fixture_cte("fx_nulls") + ", " + _sem_sql("fx_nulls", NULLS_COLS) +
          '\nSELECT col AS "column", nunique AS cardinality FROM sem2')
def b3_cardinality(spark, sf):
    return P.semantic_types(fixture(spark, sf, "fx_nulls")).select("column", "cardinality")


_SKETCHED = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag"]


@register("b3_distinct_sketch", " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", count(DISTINCT {x}) AS n_distinct, count({x}) AS n, true AS within FROM lineitem" for x in _SKETCHED))
def b3_distinct_sketch(spark, sf):
    """Distinct counts from sketches made for each line status and merged, against the exact ones: off by 4 standard errors at most."""
    df = table(spark, sf, "lineitem")
    told = K.distinct_estimates(K.merged_states(K.distinct_states(df, _SKETCHED, by="l_linestatus")))
    exact = df.agg(*[F.countDistinct(x).alias(x) for x in _SKETCHED])
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("n_distinct")) for x in _SKETCHED])
    off = F.abs(F.col("approx_distinct") - F.col("n_distinct")) <= 4 * 1.04 / 2 ** (K.LG_K / 2) * F.col("n_distinct") + 1
    return told.join(exact.select(F.inline(pairs)), "column").select("column", "n_distinct", "n", off.alias("within"))


# ── B4–B10 numeric ────────────────────────────────────────────────────────────

def _b4(src, col):
    return (f"SELECT {lit(col)} AS \"column\", count(x) AS count, round(avg(x), 4) AS mean, "
            f"round(quantile_cont(x, 0.5), 4) AS median, round(stddev_samp(x), 4) AS std, "
            f"round(var_samp(x), 4) AS variance, round(min(x), 4) AS min, round(max(x), 4) AS max, "
            f"round(max(x) - min(x), 4) AS range, round(quantile_cont(x, 0.25), 4) AS q1, "
            f"round(quantile_cont(x, 0.75), 4) AS q3, "
            f"round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr FROM {dbl(src, col)}")


B4_COLS = ["column", "count", "mean", "median", "std", "variance", "min", "max", "range", "q1", "q3", "iqr"]


@register("b4_numeric_summary", per_column(LI_NUM, lambda c: _b4("lineitem", c)))
def b4_numeric_summary(spark, sf):
    return P.numeric_summary(table(spark, sf, "lineitem"), LI_NUM, with_shapiro=False).select(*B4_COLS)


def _b5(src, col):
    return (f"SELECT {lit(col)} AS \"column\", round(CASE WHEN count(x) < 3 THEN NULL ELSE coalesce(skewness(x), 0) END, 4) AS skewness, "
            f"round(CASE WHEN count(x) < 4 THEN NULL ELSE coalesce(kurtosis(x), 0) END, 4) AS kurtosis FROM {dbl(src, col)}")


@register("b5_shape_moments", fixture_cte("fx_shapes") + per_column(SHAPES_NUM, lambda c: _b5("fx_shapes", c)))
def b5_shape_moments(spark, sf):
    return P.numeric_summary(fixture(spark, sf, "fx_shapes"), SHAPES_NUM, with_shapiro=False).select(
        "column", "skewness", "kurtosis")


def _b6(src, col):
    return (f"SELECT {lit(col)} AS \"column\", count_if(x = 0) AS zeros_count, "
            f"round(CAST(count_if(x = 0) AS DOUBLE) * 100 / count(x), 2) AS zeros_pct, count_if(x < 0) AS negatives_count, "
            f"CASE WHEN avg(x) <> 0 THEN round(stddev_samp(x) / avg(x), 4) END AS cv FROM {dbl(src, col)}")


@register("b6_zero_negative_cv", fixture_cte("fx_shapes") + per_column(SHAPES_NUM, lambda c: _b6("fx_shapes", c)))
def b6_zero_negative_cv(spark, sf):
    return P.numeric_summary(fixture(spark, sf, "fx_shapes"), SHAPES_NUM, with_shapiro=False).select(
        "column", "zeros_count", "zeros_pct", "negatives_count", "cv")


def _bounds_cte(src, col):
    return (f"(SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, count(x) AS n, avg(x) AS m, "
            f"stddev_pop(x) AS sd FROM {dbl(src, col)})")


def _b7(src, col):
    lo, hi = "(b.q1 - 1.5 * (b.q3 - b.q1))", "(b.q3 + 1.5 * (b.q3 - b.q1))"
    cnt = f"count_if(d.x < {lo} OR d.x > {hi})"
    return (f"SELECT {lit(col)} AS \"column\", CASE WHEN b.n >= 4 THEN {cnt} END AS iqr_outlier_count, "
            f"CASE WHEN b.n >= 4 THEN round(CAST({cnt} AS DOUBLE) * 100 / b.n, 2) END AS iqr_outlier_pct, "
            f"CASE WHEN b.n >= 4 THEN round({lo}, 4) END AS iqr_lower_bound, "
            f"CASE WHEN b.n >= 4 THEN round({hi}, 4) END AS iqr_upper_bound "
            f"FROM {dbl(src, col)} d, {_bounds_cte(src, col)} b WHERE d.x IS NOT NULL GROUP BY b.n, b.q1, b.q3")


@register("b7_outliers_iqr", fixture_cte("fx_shapes") + per_column(SHAPES_NUM, lambda c: _b7("fx_shapes", c)))
def b7_outliers_iqr(spark, sf):
    return P.numeric_summary(fixture(spark, sf, "fx_shapes"), SHAPES_NUM, with_shapiro=False).select(
        "column", "iqr_outlier_count", "iqr_outlier_pct", "iqr_lower_bound", "iqr_upper_bound")


def _b8(src, col):
    cnt = "count_if(b.sd > 0 AND abs(d.x - b.m) > 3 * b.sd)"
    return (f"SELECT {lit(col)} AS \"column\", CASE WHEN b.n >= 4 THEN {cnt} END AS zscore_outlier_count, "
            f"CASE WHEN b.n >= 4 THEN round(CAST({cnt} AS DOUBLE) * 100 / b.n, 2) END AS zscore_outlier_pct "
            f"FROM {dbl(src, col)} d, {_bounds_cte(src, col)} b WHERE d.x IS NOT NULL GROUP BY b.n, b.m, b.sd")


@register("b8_outliers_zscore", fixture_cte("fx_shapes") + per_column(SHAPES_NUM, lambda c: _b8("fx_shapes", c)))
def b8_outliers_zscore(spark, sf):
    return P.numeric_summary(fixture(spark, sf, "fx_shapes"), SHAPES_NUM, with_shapiro=False).select(
        "column", "zscore_outlier_count", "zscore_outlier_pct")


def k2_sql(src_rows: str) -> str:
    """DuckDB K² from a relation with columns (col, n, g1, g2) — population skewness / excess kurtosis."""
    return f"""s1 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y0,
        3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
        g2 + 3 AS b2, 3.0 * (n - 1) / (n + 1) AS e, 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS varb2,
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb1
      FROM {src_rows}),
s2 AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, (b2 - e) / sqrt(varb2) AS xk,
        6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS a, CASE WHEN y0 = 0 THEN 1.0 ELSE y0 END AS y FROM s1),
s3 AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, y / sqrt(2.0 / (w2 - 1)) AS ya, 1 + xk * sqrt(2 / (a - 4.0)) AS denom FROM s2),
s4 AS (SELECT *, delta * ln(ya + sqrt(ya * ya + 1)) AS zs,
        CASE WHEN denom = 0 THEN NULL ELSE ((1 - 2 / (9.0 * a)) - sign(denom) * pow((1 - 2.0 / a) / abs(denom), 1 / 3.0)) / sqrt(2 / (9.0 * a)) END AS zk
      FROM s3),
k2 AS (SELECT *, zs * zs + zk * zk AS k2 FROM s4)"""


def _b9_rows(src, col):
    return (f"SELECT {lit(col)} AS col, CAST(count(x) AS DOUBLE) AS n, "
            f"skewness(x) * (count(x) - 2) / sqrt(CAST(count(x) AS DOUBLE) * (count(x) - 1)) AS g1, "
            f"kurtosis_pop(x) AS g2 FROM {dbl(src, col)}")


B9_SQL = ("WITH rows AS (" + per_column(LI_NUM, lambda c: _b9_rows("lineitem", c)) + "),\n" + k2_sql("rows") +
          """
SELECT col AS "column",
       CASE WHEN n < 8 THEN 'insufficient_data' WHEN n <= 2000 THEN 'shapiro_wilk' ELSE 'dagostino_pearson' END AS normality_test,
       CASE WHEN n > 2000 THEN round(k2, 4) END AS normality_stat,
       CASE WHEN n > 2000 THEN round(exp(-k2 / 2), 4) END AS normality_p,
       CASE WHEN n > 2000 THEN exp(-k2 / 2) > 0.05 END AS is_normal
FROM k2""")


@register("b9_normality", B9_SQL)
def b9_normality(spark, sf):
    return P.numeric_summary(table(spark, sf, "lineitem"), LI_NUM, with_shapiro=False).select(
        "column", "normality_test", "normality_stat", "normality_p", "is_normal")


@register("b9_normality_shapiro")
def b9_normality_shapiro(spark, sf):
    """Shapiro-Wilk branch (n ≤ 2000) on customer balances, per market segment (rows-only check)."""
    df = table(spark, sf, "customer")
    from tabprobe.operators.longform import numeric_long
    lg = numeric_long(df, ["c_acctbal"], keep=["c_mktsegment"])
    return P.shapiro_by_group(lg, ["c_mktsegment", "column"])


SHAPE_SQL = """CASE WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 1 THEN 'normal-like'
       WHEN skewness > 1 THEN 'right-skewed' WHEN skewness < -1 THEN 'left-skewed'
       WHEN kurtosis > 3 THEN 'leptokurtic (heavy tails)' WHEN kurtosis < -1 THEN 'platykurtic (light tails)'
       ELSE 'moderate' END"""


@register("b10_distribution_shape", fixture_cte("fx_shapes") + "SELECT \"column\", " + SHAPE_SQL +
          " AS distribution_shape FROM (" + per_column(SHAPES_NUM, lambda c: _b5("fx_shapes", c)) + ")")
def b10_distribution_shape(spark, sf):
    return P.numeric_summary(fixture(spark, sf, "fx_shapes"), SHAPES_NUM, with_shapiro=False).select(
        "column", "distribution_shape")


# ── B11–B13 categorical ───────────────────────────────────────────────────────

def _lab_union(src, cols):
    return per_column(cols, lambda c: f"SELECT {lit(c)} AS col, CAST({qi(c)} AS VARCHAR) AS value FROM {src}")


CAT_CTE = (fixture_cte("fx_status") + ", lg AS (" + _lab_union("fx_status", STATUS_CAT) + "),\n"
           "vc AS (SELECT col, value, count(*) AS cnt FROM lg WHERE value IS NOT NULL GROUP BY col, value),\n"
           "tot AS (SELECT col, sum(cnt) AS n, count(*) AS u FROM vc GROUP BY col),\n"
           "rk AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, value ASC) AS r, "
           "row_number() OVER (PARTITION BY col ORDER BY cnt ASC, value DESC) AS rb FROM vc)\n")


@register("b11_categorical_summary", CAT_CTE + """
SELECT t.col AS "column", CAST(t.n AS BIGINT) AS count, t.u AS unique_values, a.value AS top_value,
       round(CAST(a.cnt AS DOUBLE) * 100 / t.n, 2) AS top_value_pct, b.value AS bottom_value, b.cnt AS bottom_value_count
FROM tot t JOIN rk a ON a.col = t.col AND a.r = 1 JOIN rk b ON b.col = t.col AND b.rb = 1""")
def b11_categorical_summary(spark, sf):
    return P.categorical_summary(fixture(spark, sf, "fx_status"), STATUS_CAT).select(
        "column", "count", "unique_values", "top_value", "top_value_pct", "bottom_value", "bottom_value_count")


@register("b11_top_values", CAT_CTE + 'SELECT col AS "column", r AS rank, value, cnt AS count FROM rk WHERE r <= 5')
def b11_top_values(spark, sf):
    return P.top_values(P.label_counts(fixture(spark, sf, "fx_status"), STATUS_CAT), 5)


@register("b12_entropy", CAT_CTE + """
SELECT v.col AS "column", round(sum(-(CAST(v.cnt AS DOUBLE) / t.n) * log2(CAST(v.cnt AS DOUBLE) / t.n + 1e-9)), 4) AS entropy
FROM vc v JOIN tot t ON t.col = v.col GROUP BY v.col""")
def b12_entropy(spark, sf):
    return P.categorical_summary(fixture(spark, sf, "fx_status"), STATUS_CAT).select("column", "entropy")


@register("b13_dominance_cardinality", CAT_CTE + """
SELECT t.col AS "column", round(CAST(a.cnt AS DOUBLE) / t.n, 4) AS dominance,
       round(CAST(t.u AS DOUBLE) / greatest(t.n, 1), 4) AS cardinality_ratio
FROM tot t JOIN rk a ON a.col = t.col AND a.r = 1""")
def b13_dominance_cardinality(spark, sf):
    return P.categorical_summary(fixture(spark, sf, "fx_status"), STATUS_CAT).select(
        "column", "dominance", "cardinality_ratio")


# ── B14–B16 ───────────────────────────────────────────────────────────────────

def _b14(src, col):
    return (f"SELECT {lit(col)} AS \"column\", count(x) AS count, CAST(min(x) AS VARCHAR) AS min, CAST(max(x) AS VARCHAR) AS max, "
            f"CAST(floor((epoch_us(max(x)) - epoch_us(min(x))) / 86400000000.0) AS BIGINT) AS range_days, "
            f"count(DISTINCT x) AS unique_dates FROM (SELECT CAST({qi(col)} AS TIMESTAMP) AS x FROM {src})")


@register("b14_datetime_summary", fixture_cte("fx_purchase") + per_column(["ts"], lambda c: _b14("fx_purchase", c))
          + "\nUNION ALL\n" + _b14("orders", "o_orderdate"))
def b14_datetime_summary(spark, sf):
    a = P.datetime_summary(fixture(spark, sf, "fx_purchase"), ["ts"])
    b = P.datetime_summary(table(spark, sf, "orders"), ["o_orderdate"])
    return a.unionByName(b)


@register("b15_column_type_lists", fixture_cte("fx_shapes") + ", " + _sem_sql("fx_shapes", SHAPES_COLS) + """
SELECT semantic_type, count(*) AS n_columns, string_agg(col, ',' ORDER BY pos) AS columns FROM sem GROUP BY semantic_type""")
def b15_column_type_lists(spark, sf):
    s = P.semantic_types(fixture(spark, sf, "fx_shapes"))
    return P.column_type_lists(s)


def _width_sql(col, kind):
    if kind == "string":
        return f"coalesce(sum(strlen({qi(col)})), 0)"
    return {"int": "4", "bigint": "8"}.get(kind, "8") + " * count(*)"


ORDERS_W = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
            ("o_orderdate", "timestamp"), ("o_orderpriority", "string")]


@register("b16_table_overview", f"""
SELECT count(*) AS num_rows, CAST(6 AS BIGINT) AS num_columns, count(*) * 6 AS total_cells,
       round(CAST({' + '.join(_width_sql(c, k) for c, k in ORDERS_W)} AS DOUBLE) / 1048576, 3) AS memory_usage_mb
FROM orders""")
def b16_table_overview(spark, sf):
    return P.table_overview(table(spark, sf, "orders"))


# ── whole profile ─────────────────────────────────────────────────────────────

@register("b0_profile_columns")
def b0_profile_columns(spark, sf):
    """The whole column profile of lineitem (flagship; per-operator columns are SQL-checked above)."""
    return P.profile_columns(table(spark, sf, "lineitem"))


# ── C ─────────────────────────────────────────────────────────────────────────

NULLS_PROF = fixture_cte("fx_nulls") + ", " + profile_ctes("fx_nulls", NULLS_COLS)
SHAPES_PROF = fixture_cte("fx_shapes") + ", " + profile_ctes("fx_shapes", SHAPES_COLS)


@register("c1_missing_overall", NULLS_PROF + """
SELECT sum(n_rows - n) AS total_missing_cells, round(CAST(sum(n_rows - n) AS DOUBLE) * 100 / sum(n_rows), 2) AS total_missing_pct,
       count_if(n_rows - n > 0) AS columns_with_missing, count_if(n = 0 AND n_rows > 0) AS columns_all_missing FROM sem2""")
def c1_missing_overall(spark, sf):
    return Q.missing_overall(P.column_basics(fixture(spark, sf, "fx_nulls")))


@register("c2_co_missing_pairs", fixture_cte("fx_nulls") + """
SELECT 'o_totalprice' AS col_a, 'o_orderpriority' AS col_b, count_if(o_totalprice IS NULL AND o_orderpriority IS NULL) AS co_missing_count
FROM fx_nulls""")
def c2_co_missing_pairs(spark, sf):
    df = fixture(spark, sf, "fx_nulls")
    b = P.column_basics(df)
    with_missing = [r["column"] for r in b.where(F.col("missing") > 0).orderBy("pos").select("column").collect()]
    return Q.co_missing_pairs(df, with_missing)


@register("c3_duplicate_rows", fixture_cte("fx_dups") + """
SELECT CAST(coalesce(sum(cnt - 1), 0) AS BIGINT) AS duplicate_rows, round(CAST(coalesce(sum(cnt - 1), 0) AS DOUBLE) * 100 / sum(cnt), 2) AS duplicate_rows_pct
FROM (SELECT count(*) AS cnt FROM fx_dups GROUP BY user_id, event_type)""")
def c3_duplicate_rows(spark, sf):
    return Q.duplicate_rows(fixture(spark, sf, "fx_dups"))


@register("c4_duplicate_values", NULLS_PROF + """
SELECT col AS "column", n_rows - nunique - CASE WHEN n_rows - n > 0 THEN 1 ELSE 0 END AS duplicate_values
FROM sem2 WHERE n_rows - nunique - CASE WHEN n_rows - n > 0 THEN 1 ELSE 0 END > 0""")
def c4_duplicate_values(spark, sf):
    return Q.duplicate_values(P.column_basics(fixture(spark, sf, "fx_nulls")))


PRICE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross_price", "net_price"]


def _pairs_sql(src, cols):
    from itertools import combinations
    return per_column(list(combinations(cols, 2)), lambda p: (
        f"SELECT {lit(p[0])} AS col_a, {lit(p[1])} AS col_b, count(*) AS n, "
        f"CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN greatest(-1.0, least(1.0, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)))) END AS r "
        f"FROM (SELECT CAST({qi(p[0])} AS DOUBLE) AS a, CAST({qi(p[1])} AS DOUBLE) AS b FROM {src}) WHERE a IS NOT NULL AND b IS NOT NULL"))


@register("c5_pearson_flags", fixture_cte("fx_price") + "SELECT col_a, col_b, round(r, 4) AS pearson_r, 'high_multicollinearity' AS flag FROM ("
          + _pairs_sql("fx_price", PRICE_NUM) + ") WHERE abs(r) > 0.85")
def c5_pearson_flags(spark, sf):
    return Q.pearson_flags(Q.pearson_pairs(fixture(spark, sf, "fx_price"), PRICE_NUM))


@register("c6_quality_score", NULLS_PROF + """,
d AS (SELECT coalesce(sum(cnt - 1), 0) AS dup FROM (SELECT count(*) AS cnt FROM fx_nulls GROUP BY o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_totalprice, o_orderpriority)),
t AS (SELECT count(*) AS n_cols, max(n_rows) AS n_rows, sum(n_rows - n) AS miss, count_if(semantic_type IN ('constant', 'id')) AS bad FROM sem2),
h AS (SELECT count_if(iqr_outlier_pct > 20) AS heavy FROM prof2),
s AS (SELECT (1 - CAST(t.miss AS DOUBLE) / (t.n_rows * t.n_cols)) * 100 AS c, (1 - CAST(d.dup AS DOUBLE) / t.n_rows) * 100 AS u,
             greatest(0.0, (1 - CAST(t.bad AS DOUBLE) / t.n_cols) * 100) AS k, greatest(0.0, (1 - CAST(h.heavy AS DOUBLE) / t.n_cols) * 100) AS v
      FROM t, d, h)
SELECT round((c + u + k + v) / 4, 1) AS overall, round(c, 1) AS completeness, round(u, 1) AS uniqueness,
       round(k, 1) AS consistency, round(v, 1) AS validity,
       CASE WHEN round((c + u + k + v) / 4, 1) >= 85 THEN 'A' WHEN round((c + u + k + v) / 4, 1) >= 70 THEN 'B'
            WHEN round((c + u + k + v) / 4, 1) >= 55 THEN 'C' ELSE 'D' END AS grade FROM s""")
def c6_quality_score(spark, sf):
    df = fixture(spark, sf, "fx_nulls")
    prof = _nulls_profile(spark, sf)
    return Q.quality_score(prof.withColumnRenamed("missing_count", "missing"), prof, Q.duplicate_rows(df))


WARN_SQL = """
SELECT "column", code, value FROM (
  SELECT "column", 'constant' AS code, CAST(NULL AS DOUBLE) AS value FROM prof2 WHERE semantic_type = 'constant'
  UNION ALL SELECT "column", 'id_column', CAST(NULL AS DOUBLE) FROM prof2 WHERE semantic_type = 'id'
  UNION ALL SELECT "column", 'high_missing', missing_pct FROM prof2 WHERE missing_pct > 40
  UNION ALL SELECT "column", 'many_outliers', iqr_outlier_pct FROM prof2 WHERE iqr_outlier_pct > 15
  UNION ALL SELECT "column", 'near_constant', dominance FROM prof2 WHERE dominance > 0.95
  UNION ALL SELECT "column", 'right_skewed', skewness FROM prof2 WHERE distribution_shape = 'right-skewed'
  UNION ALL SELECT "column", 'many_zeros', zeros_pct FROM prof2 WHERE zeros_pct > 30
  UNION ALL SELECT "column", 'high_cardinality', CAST(unique_values AS DOUBLE) FROM prof2 WHERE cardinality_ratio > 0.9 AND semantic_type = 'categorical'
  UNION ALL SELECT NULL, 'dataset_missing', v FROM (SELECT round(CAST(sum(n_rows - n) AS DOUBLE) * 100 / sum(n_rows), 2) AS v FROM sem2) WHERE v > 20
  UNION ALL SELECT NULL, 'duplicate_rows', v FROM (SELECT round(CAST(coalesce(sum(cnt - 1), 0) AS DOUBLE) * 100 / sum(cnt), 2) AS v
                                                   FROM (SELECT count(*) AS cnt FROM {src} GROUP BY {keys})) WHERE v > 1)"""


@register("c7_quality_warnings", SHAPES_PROF + WARN_SQL.format(src="fx_shapes", keys=", ".join(c for c, _ in SHAPES_COLS)))
def c7_quality_warnings(spark, sf):
    df = fixture(spark, sf, "fx_shapes")
    prof = _shapes_profile(spark, sf)
    return Q.quality_warnings(prof, Q.missing_overall(P.column_basics(df)), Q.duplicate_rows(df))


FE_SQL = """
SELECT "column", t AS suggested_transform, p AS priority, r AS reason FROM (
 SELECT "column",
  CASE WHEN semantic_type IN ('constant', 'id') THEN 'drop' WHEN coalesce(missing_pct, 0) > 40 THEN 'drop'
       WHEN semantic_type IN ('datetime', 'datetime_string') THEN 'cyclical'
       WHEN abs(coalesce(skewness, 0)) > 1 AND coalesce(negatives_count, 0) = 0 THEN 'log1p'
       WHEN abs(coalesce(skewness, 0)) > 1 AND coalesce(negatives_count, 0) > 0 THEN 'yeo_johnson'
       WHEN semantic_type = 'categorical' AND coalesce(cardinality_ratio, 0) > 0.2 THEN 'target_encode'
       WHEN coalesce(iqr_outlier_pct, 0) > 15 THEN 'winsorize' END AS t,
  CASE WHEN semantic_type IN ('constant', 'id') THEN 'high' WHEN coalesce(missing_pct, 0) > 40 THEN 'high'
       WHEN semantic_type IN ('datetime', 'datetime_string') THEN 'high'
       WHEN abs(coalesce(skewness, 0)) > 1 AND coalesce(negatives_count, 0) = 0 THEN CASE WHEN abs(coalesce(skewness, 0)) > 2 THEN 'high' ELSE 'medium' END
       WHEN abs(coalesce(skewness, 0)) > 1 AND coalesce(negatives_count, 0) > 0 THEN 'medium'
       WHEN semantic_type = 'categorical' AND coalesce(cardinality_ratio, 0) > 0.2 THEN 'medium'
       WHEN coalesce(iqr_outlier_pct, 0) > 15 THEN 'medium' ELSE 'low' END AS p,
  CASE WHEN semantic_type IN ('constant', 'id') THEN 'constant_or_id' WHEN coalesce(missing_pct, 0) > 40 THEN 'too_sparse'
       WHEN semantic_type IN ('datetime', 'datetime_string') THEN 'datetime'
       WHEN abs(coalesce(skewness, 0)) > 1 AND coalesce(negatives_count, 0) = 0 THEN 'skewed_non_negative'
       WHEN abs(coalesce(skewness, 0)) > 1 AND coalesce(negatives_count, 0) > 0 THEN 'skewed_with_negatives'
       WHEN semantic_type = 'categorical' AND coalesce(cardinality_ratio, 0) > 0.2 THEN 'high_cardinality'
       WHEN coalesce(iqr_outlier_pct, 0) > 15 THEN 'many_outliers' ELSE 'no_signal' END AS r
 FROM prof2 WHERE "column" <> '{target}')"""


@register("c8_fe_recommendations", SHAPES_PROF + FE_SQL.format(target="flag"))
def c8_fe_recommendations(spark, sf):
    return Q.fe_recommendations(_shapes_profile(spark, sf), target="flag")


@register("c9_downstream_lists", SHAPES_PROF + """
SELECT "column", semantic_type IN ('constant', 'id') AS drop_candidate,
       coalesce(missing_pct, 0) > 40 AND "column" <> 'flag' AS high_missing,
       abs(coalesce(skewness, 0)) > 1 AS skewed,
       semantic_type = 'categorical' AND coalesce(cardinality_ratio, 0) > 0.5 AS high_cardinality,
       semantic_type IN ('categorical', 'boolean') AND "column" <> 'flag' AS needs_encoding,
       coalesce(iqr_outlier_pct, 0) > 10 AS outlier
FROM prof2""")
def c9_downstream_lists(spark, sf):
    return Q.downstream_lists(_shapes_profile(spark, sf), target="flag")
