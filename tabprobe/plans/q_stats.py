"""Registered queries for the statistical tests (E).

Oracles check the statistics (t, F, H, U, z, chi², r, rho, effect sizes, MI);
p-values that need special functions are unit-tested against published values.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabprobe.functions.columns import r4
from tabprobe.operators import stats as S
from tabprobe.plans.q_profile import k2_sql
from tabprobe.plans.registry import register
from tabprobe.plans.sqlgen import lit, per_column, qi
from tabprobe.sources.tables import fixture, fixture_cte

SIGNAL_NUM = ["user_id", "value", "mixed"]
STATUS_NUM = ["o_totalprice", "c_acctbal"]
STATUS_NUM3 = ["o_orderkey", "o_totalprice", "c_acctbal"]
STATUS_CAT = ["o_orderpriority", "c_mktsegment"]
PRICE_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross_price"]
PRICE_NUM = PRICE_FEATS + ["net_price"]


def _lg(src, cols, target):
    return per_column(cols, lambda c: (
        f"SELECT {lit(c)} AS col, CAST({qi(target)} AS VARCHAR) AS class, CAST({qi(c)} AS DOUBLE) AS x FROM {src} "
        f"WHERE {qi(target)} IS NOT NULL AND {qi(c)} IS NOT NULL"))


def _groups_sql(src, cols, target):
    return f"""lg0 AS ({_lg(src, cols, target)}),
g AS (SELECT col, class, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS var,
             count(*) OVER (PARTITION BY col) AS n_groups, row_number() OVER (PARTITION BY col ORDER BY class) AS gi
      FROM lg0 GROUP BY col, class HAVING count(*) >= 3),
lg AS (SELECT lg0.* FROM lg0 JOIN g USING (col, class))"""


def _anova_sql(gs):
    return f"""tot_{gs} AS (SELECT col, sum(n) AS N, count(*) AS k, sum(n * mean) / sum(n) AS gm FROM {gs} GROUP BY col),
an_{gs} AS (SELECT x.col, CAST(t.N AS BIGINT) AS N, t.k, sum(x.n * (x.mean - t.gm) * (x.mean - t.gm)) AS ssb,
                 sum((x.n - 1) * coalesce(x.var, 0)) AS ssw
          FROM {gs} x JOIN tot_{gs} t USING (col) GROUP BY x.col, t.N, t.k HAVING t.k >= 2)"""


SIG = fixture_cte("fx_signal") + ", " + _groups_sql("fx_signal", SIGNAL_NUM, "big")
STA = fixture_cte("fx_status") + ", " + _groups_sql("fx_status", STATUS_NUM, "o_orderstatus")
STA3 = fixture_cte("fx_status") + ", " + _groups_sql("fx_status", STATUS_NUM3, "o_orderstatus")


# E1 ─────────────────────────────────────────────────────────────────────────
@register("e1_group_summary", SIG + """
SELECT col AS "column", class, n, round(mean, 4) AS mean, round(std, 4) AS std, n_groups FROM g""")
def e1_group_summary(spark, sf):
    g = S.group_summary(fixture(spark, sf, "fx_signal"), SIGNAL_NUM, "big")
    return g.select("column", "class", "n", r4(F.col("mean")).alias("mean"), r4(F.col("std")).alias("std"), "n_groups")


# E3 ─────────────────────────────────────────────────────────────────────────
@register("e3_levene", STA + """,
med AS (SELECT col, class, quantile_cont(x, 0.5) AS m FROM lg GROUP BY col, class),
dev AS (SELECT lg.col, lg.class, abs(lg.x - med.m) AS x FROM lg JOIN med USING (col, class)),
gd AS (SELECT col, class, count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM dev GROUP BY col, class),
""" + _anova_sql("gd") + """
SELECT col AS "column", round((ssb / (k - 1)) / (ssw / (N - k)), 4) AS f, k - 1 AS df1, N - k AS df2 FROM an_gd""")
def e3_levene(spark, sf):
    lv = S.levene(fixture(spark, sf, "fx_status"), STATUS_NUM, "o_orderstatus")
    return lv.select("column", r4(F.col("f")).alias("f"), "df1", "df2")


# E4, E5, E15 ────────────────────────────────────────────────────────────────
TWO = SIG + """,
a AS (SELECT * FROM g WHERE gi = 1 AND n_groups = 2), b AS (SELECT * FROM g WHERE gi = 2 AND n_groups = 2),
ab AS (SELECT a.col, a.n AS n1, b.n AS n2, a.mean AS m1, b.mean AS m2, a.var AS v1, b.var AS v2 FROM a JOIN b USING (col))
"""


@register("e4_t_test_student", TWO + """
SELECT col AS "column", round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 4) AS t,
       n1 + n2 - 2 AS dof FROM ab""")
def e4_t_test_student(spark, sf):
    t = S.two_group_tests(fixture(spark, sf, "fx_signal"), SIGNAL_NUM, "big")
    return t.select("column", r4(F.col("t_student")).alias("t"), F.col("dof_student").alias("dof"))


@register("e5_t_test_welch", TWO + """
SELECT col AS "column", round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t,
       round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 4) AS dof
FROM ab""")
def e5_t_test_welch(spark, sf):
    t = S.two_group_tests(fixture(spark, sf, "fx_signal"), SIGNAL_NUM, "big")
    return t.select("column", r4(F.col("t_welch")).alias("t"), r4(F.col("dof_welch")).alias("dof"))


@register("e15_cohens_d", TWO + """
SELECT col AS "column", round(CASE WHEN sqrt((v1 + v2) / 2) > 0 THEN (m1 - m2) / sqrt((v1 + v2) / 2) ELSE 0 END, 4) AS cohens_d,
       CASE WHEN abs(CASE WHEN sqrt((v1 + v2) / 2) > 0 THEN (m1 - m2) / sqrt((v1 + v2) / 2) ELSE 0 END) < 0.2 THEN 'negligible'
            WHEN abs(CASE WHEN sqrt((v1 + v2) / 2) > 0 THEN (m1 - m2) / sqrt((v1 + v2) / 2) ELSE 0 END) < 0.5 THEN 'small'
            WHEN abs(CASE WHEN sqrt((v1 + v2) / 2) > 0 THEN (m1 - m2) / sqrt((v1 + v2) / 2) ELSE 0 END) < 0.8 THEN 'medium'
            ELSE 'large' END AS effect_label
FROM ab""")
def e15_cohens_d(spark, sf):
    t = S.two_group_tests(fixture(spark, sf, "fx_signal"), SIGNAL_NUM, "big")
    return t.select("column", r4(F.col("cohens_d")).alias("cohens_d"),
                    S.effect_label(F.col("cohens_d"), F.lit("cohens_d")).alias("effect_label"))


# E6 ─────────────────────────────────────────────────────────────────────────
RANKED = """,
rk AS (SELECT col, class, x, rank() OVER (PARTITION BY col ORDER BY x) + (count(*) OVER (PARTITION BY col, x) - 1) / 2.0 AS ar FROM lg),
rs AS (SELECT col, class, sum(ar) AS R, count(*) AS n FROM rk GROUP BY col, class),
ti AS (SELECT col, sum(t * t * t - t) AS tie, sum(t) AS NT FROM (SELECT col, x, CAST(count(*) AS DOUBLE) AS t FROM lg GROUP BY col, x) GROUP BY col)
"""


@register("e6_mann_whitney", SIG.replace("HAVING count(*) >= 3)", "HAVING count(*) >= 3)") + RANKED + """,
r1 AS (SELECT rs.col, rs.R AS R1, rs.n AS n1 FROM rs JOIN g USING (col, class) WHERE g.gi = 1 AND g.n_groups = 2),
r2 AS (SELECT rs.col, rs.n AS n2 FROM rs JOIN g USING (col, class) WHERE g.gi = 2 AND g.n_groups = 2),
u AS (SELECT r1.col, n1, n2, R1 - n1 * (n1 + 1) / 2.0 AS u1, CAST(NT AS DOUBLE) AS N, tie FROM r1 JOIN r2 USING (col) JOIN ti USING (col))
SELECT col AS "column", n1, n2, round(u1, 4) AS u,
       round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((N + 1) - tie / (N * (N - 1)))), 4) AS z
FROM u""")
def e6_mann_whitney(spark, sf):
    m = S.mann_whitney(fixture(spark, sf, "fx_signal"), SIGNAL_NUM, "big")
    return m.select("column", "n1", "n2", r4(F.col("u")).alias("u"), r4(F.col("z")).alias("z"))


# E7, E14 ────────────────────────────────────────────────────────────────────
ANOVA_SQL = STA + ",\n" + _anova_sql("g") + """
SELECT col AS "column", round((ssb / (k - 1)) / (ssw / (N - k)), 4) AS f, k - 1 AS df1, N - k AS df2,
       round(CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) ELSE 0 END, 4) AS eta_squared FROM an_g"""


@register("e7_anova_oneway", ANOVA_SQL)
def e7_anova_oneway(spark, sf):
    a = S.anova_oneway(fixture(spark, sf, "fx_status"), STATUS_NUM, "o_orderstatus")
    return a.select("column", r4(F.col("f")).alias("f"), "df1", "df2", r4(F.col("eta_squared")).alias("eta_squared"))


@register("e14_eta_squared", STA + ",\n" + _anova_sql("g") + """
SELECT col AS "column", round(CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) ELSE 0 END, 4) AS eta_squared FROM an_g""")
def e14_eta_squared(spark, sf):
    a = S.anova_oneway(fixture(spark, sf, "fx_status"), STATUS_NUM, "o_orderstatus")
    return a.select("column", r4(F.col("eta_squared")).alias("eta_squared"))


# E8, E16 ────────────────────────────────────────────────────────────────────
KW_SQL = """,
kw AS (SELECT rs.col, sum(rs.R * rs.R / rs.n) AS s, count(*) AS k, CAST(any_value(ti.NT) AS DOUBLE) AS N, any_value(ti.tie) AS tie
       FROM rs JOIN ti USING (col) GROUP BY rs.col),
kh AS (SELECT col, k, N, (12.0 / (N * (N + 1)) * s - 3 * (N + 1)) / (1 - tie / (N * N * N - N)) AS h FROM kw)
"""


@register("e8_kruskal", STA + RANKED + KW_SQL + """
SELECT col AS "column", round(h, 4) AS h, k - 1 AS dof,
       round(CASE WHEN N > k THEN (h - k + 1) / (N - k) ELSE 0 END, 4) AS epsilon_squared FROM kh""")
def e8_kruskal(spark, sf):
    k = S.kruskal(fixture(spark, sf, "fx_status"), STATUS_NUM, "o_orderstatus")
    return k.select("column", r4(F.col("h")).alias("h"), "dof", r4(F.col("epsilon_squared")).alias("epsilon_squared"))


@register("e16_epsilon_squared", STA + RANKED + KW_SQL + """
SELECT col AS "column", round(CASE WHEN N > k THEN (h - k + 1) / (N - k) ELSE 0 END, 4) AS epsilon_squared,
       CASE WHEN CASE WHEN N > k THEN (h - k + 1) / (N - k) ELSE 0 END < 0.1 THEN 'negligible'
            WHEN CASE WHEN N > k THEN (h - k + 1) / (N - k) ELSE 0 END < 0.3 THEN 'small'
            WHEN CASE WHEN N > k THEN (h - k + 1) / (N - k) ELSE 0 END < 0.5 THEN 'medium' ELSE 'large' END AS effect_label
FROM kh""")
def e16_epsilon_squared(spark, sf):
    k = S.kruskal(fixture(spark, sf, "fx_status"), STATUS_NUM, "o_orderstatus")
    return k.select("column", r4(F.col("epsilon_squared")).alias("epsilon_squared"),
                    S.effect_label(F.col("epsilon_squared"), F.lit("epsilon_squared")).alias("effect_label"))


# E9, E10, E18 ───────────────────────────────────────────────────────────────
def _xy(src, cols, target):
    return per_column(cols, lambda c: (
        f"SELECT {lit(c)} AS col, CAST({qi(c)} AS DOUBLE) AS x, CAST({qi(target)} AS DOUBLE) AS y FROM {src} "
        f"WHERE {qi(c)} IS NOT NULL AND {qi(target)} IS NOT NULL"))


CORR = """CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0
  THEN greatest(-1.0, least(1.0, covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})))) END"""


@register("e9_pearson_test", fixture_cte("fx_price") + f""", xy AS ({_xy('fx_price', PRICE_FEATS, 'net_price')}),
pr AS (SELECT col, count(*) AS n, {CORR.format(a='x', b='y')} AS r FROM xy GROUP BY col HAVING count(*) >= 10)
SELECT col AS "column", n, round(r, 4) AS r, round(CASE WHEN abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END, 4) AS t FROM pr""")
def e9_pearson_test(spark, sf):
    p = S.pearson_test(fixture(spark, sf, "fx_price"), PRICE_FEATS, "net_price")
    return p.select("column", "n", r4(F.col("r")).alias("r"), r4(F.col("t")).alias("t"))


SPEAR = """rx AS (SELECT col, x, y, rank() OVER (PARTITION BY col ORDER BY x) + (count(*) OVER (PARTITION BY col, x) - 1) / 2.0 AS ax,
                   rank() OVER (PARTITION BY col ORDER BY y) + (count(*) OVER (PARTITION BY col, y) - 1) / 2.0 AS ay FROM xy)"""


@register("e10_spearman_test", fixture_cte("fx_price") + f""", xy AS ({_xy('fx_price', PRICE_FEATS, 'net_price')}),
{SPEAR},
sr AS (SELECT col, count(*) AS n, {CORR.format(a='ax', b='ay')} AS rho FROM rx GROUP BY col HAVING count(*) >= 10)
SELECT col AS "column", n, round(rho, 4) AS rho FROM sr""")
def e10_spearman_test(spark, sf):
    s = S.spearman_test(fixture(spark, sf, "fx_price"), PRICE_FEATS, "net_price")
    return s.select("column", "n", r4(F.col("rho")).alias("rho"))


@register("e18_point_biserial", fixture_cte("fx_purchase") + f""", xy AS ({_xy('fx_purchase', ['is_purchase'], 'value')}),
e AS (SELECT xy.col, CASE WHEN x = mx THEN 1.0 ELSE 0.0 END AS x, y FROM xy JOIN
      (SELECT col, max(x) AS mx FROM xy GROUP BY col HAVING count(DISTINCT x) = 2) m USING (col)),
pr AS (SELECT col, count(*) AS n, {CORR.format(a='x', b='y')} AS r FROM e GROUP BY col)
SELECT col AS "column", n, round(r, 4) AS r, round(CASE WHEN abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END, 4) AS t FROM pr""")
def e18_point_biserial(spark, sf):
    p = S.point_biserial(fixture(spark, sf, "fx_purchase"), ["is_purchase"], "value")
    return p.select("column", "n", r4(F.col("r")).alias("r"), r4(F.col("t")).alias("t"))


# E12, E13 ───────────────────────────────────────────────────────────────────
CHI = fixture_cte("fx_status") + ", lab AS (" + per_column(STATUS_CAT, lambda c: (
    f"SELECT {lit(c)} AS col, CAST({qi(c)} AS VARCHAR) AS level, CAST(o_orderstatus AS VARCHAR) AS class FROM fx_status "
    f"WHERE {qi(c)} IS NOT NULL AND o_orderstatus IS NOT NULL")) + """),
obs AS (SELECT col, level, class, count(*) AS o FROM lab GROUP BY ALL),
rows_ AS (SELECT col, level, sum(o) AS ri FROM obs GROUP BY col, level),
cols_ AS (SELECT col, class, sum(o) AS cj FROM obs GROUP BY col, class),
shape AS (SELECT c.col, sum(c.cj) AS N, count(*) AS k, any_value(r.r) AS r FROM cols_ c JOIN (SELECT col, count(*) AS r FROM rows_ GROUP BY col) r USING (col) GROUP BY c.col),
cells AS (SELECT r.col, r.level, c.class, coalesce(o.o, 0) AS o, CAST(r.ri AS DOUBLE) * c.cj / s.N AS e, (s.r - 1) * (s.k - 1) AS dof, s.N, s.r, s.k
          FROM rows_ r JOIN cols_ c USING (col) JOIN shape s USING (col)
          LEFT JOIN obs o ON o.col = r.col AND o.level = r.level AND o.class = c.class WHERE s.r >= 2 AND s.k >= 2),
chi AS (SELECT col, any_value(dof) AS dof, any_value(N) AS N, least(any_value(r), any_value(k)) AS mk,
               sum(CASE WHEN dof = 1 THEN (abs(o - e) - least(0.5, abs(o - e))) * (abs(o - e) - least(0.5, abs(o - e))) / e
                        ELSE (o - e) * (o - e) / e END) AS chi2,
               CAST(count_if(e < 5) AS DOUBLE) / count(*) AS low FROM cells GROUP BY col)
"""


@register("e12_chi_square", CHI + """
SELECT col AS "column", round(chi2, 4) AS statistic, CAST(dof AS BIGINT) AS dof, round(low * 100, 1) AS pct_cells_low_expected,
       low < 0.2 AS expected_freq_assumption_ok FROM chi""")
def e12_chi_square(spark, sf):
    ch = S.chi_square(fixture(spark, sf, "fx_status"), STATUS_CAT, "o_orderstatus")
    from tabprobe.functions.columns import rnd
    return ch.select("column", r4(F.col("statistic")).alias("statistic"), "dof",
                     rnd(F.col("pct_cells_low_expected"), 1).alias("pct_cells_low_expected"), "expected_freq_assumption_ok")


@register("e13_cramers_v", CHI + """
SELECT col AS "column", round(CASE WHEN mk > 1 THEN sqrt(chi2 / (N * (mk - 1))) ELSE 0 END, 4) AS cramers_v FROM chi""")
def e13_cramers_v(spark, sf):
    ch = S.chi_square(fixture(spark, sf, "fx_status"), STATUS_CAT, "o_orderstatus")
    return ch.select("column", r4(F.col("cramers_v")).alias("cramers_v"))


# E17 on Pearson r ───────────────────────────────────────────────────────────
@register("e17_effect_label", fixture_cte("fx_price") + f""", xy AS ({_xy('fx_price', PRICE_FEATS, 'net_price')}),
pr AS (SELECT col, {CORR.format(a='x', b='y')} AS r FROM xy GROUP BY col HAVING count(*) >= 10)
SELECT col AS "column", CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'small'
       WHEN abs(r) < 0.5 THEN 'medium' ELSE 'large' END AS effect_label FROM pr""")
def e17_effect_label(spark, sf):
    p = S.pearson_test(fixture(spark, sf, "fx_price"), PRICE_FEATS, "net_price")
    return p.select("column", S.effect_label(F.col("r"), F.lit("pearson_r")).alias("effect_label"))


# E19 ────────────────────────────────────────────────────────────────────────
def _spair(a, b):
    return (f"SELECT {lit(a)} AS col_a, {lit(b)} AS col_b, count(*) AS n, {CORR.format(a='ax', b='ay')} AS rho FROM "
            f"(SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ax, "
            f"rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ay FROM "
            f"(SELECT CAST({qi(a)} AS DOUBLE) AS x, CAST({qi(b)} AS DOUBLE) AS y FROM fx_price WHERE {qi(a)} IS NOT NULL AND {qi(b)} IS NOT NULL))")


@register("e19_spearman_collinearity", fixture_cte("fx_price") + "SELECT col_a, col_b, n, round(rho, 4) AS rho FROM ("
          + per_column(list(combinations(PRICE_NUM, 2)), lambda p: _spair(*p)) + ") WHERE n >= 10 AND abs(rho) > 0.85")
def e19_spearman_collinearity(spark, sf):
    s = S.spearman_collinearity(fixture(spark, sf, "fx_price"), PRICE_NUM)
    return s.select("col_a", "col_b", "n", r4(F.col("rho")).alias("rho"))


# E20 ────────────────────────────────────────────────────────────────────────
@register("e20_bh_fdr", STA3 + RANKED + KW_SQL + """,
p AS (SELECT col AS feature, exp(-h / 2) AS p FROM kh),
o AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS kk, count(*) OVER () AS nn FROM p),
a AS (SELECT *, least(1.0, p * nn / kk) AS adj, max(CASE WHEN p <= kk * 0.05 / nn THEN kk END) OVER () AS kmax FROM o)
SELECT feature, round(p, 4) AS p_value, round(min(adj) OVER (ORDER BY kk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS p_adjusted,
       coalesce(kk <= kmax, false) AS significant_after_fdr FROM a""")
def e20_bh_fdr(spark, sf):
    k = S.kruskal(fixture(spark, sf, "fx_status"), STATUS_NUM3, "o_orderstatus")
    b = S.bh_fdr(k.select(F.col("column").alias("feature"), "p_value"))
    return b.select("feature", r4(F.col("p_value")).alias("p_value"), r4(F.col("p_adjusted")).alias("p_adjusted"),
                    "significant_after_fdr")


# E21 ────────────────────────────────────────────────────────────────────────
MI_SQL = fixture_cte("fx_signal") + ", num AS (" + per_column(SIGNAL_NUM, lambda c: (
    f"SELECT {lit(c)} AS col, CAST({qi(c)} AS DOUBLE) AS x, CAST(big AS VARCHAR) AS y FROM fx_signal WHERE big IS NOT NULL")) + """),
nb AS (SELECT col, y, CASE WHEN x IS NULL THEN '-1' ELSE CAST(CAST(floor((rank() OVER (PARTITION BY col, x IS NULL ORDER BY x) - 1) * 20
          / count(x) OVER (PARTITION BY col)) AS BIGINT) AS VARCHAR) END AS xb FROM num),
cat AS (SELECT 'event_type' AS col, CAST(big AS VARCHAR) AS y, coalesce(CAST(event_type AS VARCHAR), '__null__') AS xb FROM fx_signal WHERE big IS NOT NULL),
allx AS (SELECT col, xb, y FROM nb UNION ALL SELECT col, xb, y FROM cat),
xy AS (SELECT col, xb, y, count(*) AS nxy FROM allx GROUP BY ALL),
nx AS (SELECT col, xb, sum(nxy) AS nx FROM xy GROUP BY col, xb),
ny AS (SELECT col, y, sum(nxy) AS ny FROM xy GROUP BY col, y),
n AS (SELECT col, sum(nxy) AS n FROM xy GROUP BY col)
SELECT xy.col AS "column", round(greatest(sum(CAST(nxy AS DOUBLE) / n * ln(CAST(nxy AS DOUBLE) * n / (nx * ny))), 0), 4) AS mi
FROM xy JOIN nx USING (col, xb) JOIN ny USING (col, y) JOIN n USING (col) GROUP BY xy.col"""


@register("e21_mutual_information", MI_SQL)
def e21_mutual_information(spark, sf):
    m = S.mutual_information(fixture(spark, sf, "fx_signal"), SIGNAL_NUM, ["event_type"], "big")
    return m.select("column", r4(F.col("mi")).alias("mi"))


# E2, E22–E25 (normality gate on samples → rows-only) ────────────────────────
@register("e2_normality_gate", STA + """,
shape AS (SELECT col, class, CAST(count(x) AS DOUBLE) AS n, skewness(x) * (count(x) - 2) / sqrt(CAST(count(x) AS DOUBLE) * (count(x) - 1)) AS g1,
                 kurtosis_pop(x) AS g2 FROM lg0 GROUP BY col, class),
""" + k2_sql("shape") + """
SELECT col AS "column", bool_and(n >= 8 AND coalesce(NOT isnan(k2) AND exp(-k2 / 2) > 0.05, false)) AS normal FROM k2 GROUP BY col""")
def e2_normality_gate(spark, sf):
    df = fixture(spark, sf, "fx_status")
    lg = S.class_long(df, STATUS_NUM, "o_orderstatus")
    return S.normality_gate(lg, ["column", "class"])


@register("e25_test_features")
def e25_test_features(spark, sf):
    """Router over a classification table: numeric features get t / Mann-Whitney / ANOVA / Kruskal, categories chi²."""
    return S.test_features(fixture(spark, sf, "fx_status"), "o_orderstatus", "classification")


@register("e25_test_features_regression")
def e25_test_features_regression(spark, sf):
    return S.test_features(fixture(spark, sf, "fx_price"), "net_price", "regression")


def _ranked(spark, sf):
    df = fixture(spark, sf, "fx_signal")
    tests = S.test_features(df, "big", "classification")
    mi = S.mutual_information(df, ["event_id", "user_id", "value", "mixed"], ["event_type"], "big")
    return S.rank_features(tests, mi)


@register("e23_rank_features")
def e23_rank_features(spark, sf):
    return _ranked(spark, sf)


@register("e22_fe_signals")
def e22_fe_signals(spark, sf):
    return S.fe_signals(_ranked(spark, sf), ["event_type"])


@register("e24_warnings")
def e24_warnings(spark, sf):
    """All six kinds of warnings over the tests, signals and Spearman pairs of fx_signal."""
    df, ranked = fixture(spark, sf, "fx_signal"), _ranked(spark, sf)
    ranked = spark.createDataFrame(ranked.collect(), ranked.schema)  # a row a feature
    pairs = S.spearman_collinearity(df, ["event_id", "user_id", "value", "mixed"])
    return S.stats_warnings(ranked, S.fe_signals(ranked, ["event_type"]), pairs)


@register("e24_significance_buckets")
def e24_significance_buckets(spark, sf):
    return S.significance_buckets(_ranked(spark, sf))
