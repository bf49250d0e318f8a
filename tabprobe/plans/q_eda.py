"""Registered queries for the EDA products (D)."""

from __future__ import annotations

from itertools import combinations

from tabprobe.functions.keyhash import sql_hash
from tabprobe.operators import eda as D
from tabprobe.operators import profile as P
from tabprobe.plans.q_profile import k2_sql
from tabprobe.plans.registry import register
from tabprobe.plans.sqlgen import dbl, lit, per_column, qi
from tabprobe.sources.tables import fixture, fixture_cte, table

SIGNAL_NUM = ["user_id", "value", "mixed"]
PRICE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross_price", "net_price"]
STATUS_CAT = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]


def _long(src, cols):
    return per_column(cols, lambda c: f"SELECT {lit(c)} AS col, x FROM {dbl(src, c)}")


def _lab(src, cols, extra=""):
    return per_column(cols, lambda c: f"SELECT {lit(c)} AS col, CAST({qi(c)} AS VARCHAR) AS value{extra} FROM {src}")


# D1 ─────────────────────────────────────────────────────────────────────────
@register("d1_stable_sample", f"SELECT * FROM orders ORDER BY {sql_hash('o_orderkey')}, o_orderkey LIMIT 3000")
def d1_stable_sample(spark, sf):
    return D.stable_sample(table(spark, sf, "orders"), "o_orderkey", 3000)


# D2 ─────────────────────────────────────────────────────────────────────────
def _numstats_sql(src, cols):
    body = per_column(cols, lambda c: (
        f"SELECT {lit(c)} AS col, CAST(count(x) AS DOUBLE) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, "
        f"stddev_samp(x) AS std, skewness(x) AS G1, kurtosis(x) AS G2, "
        f"skewness(x) * (count(x) - 2) / sqrt(CAST(count(x) AS DOUBLE) * (count(x) - 1)) AS g1, kurtosis_pop(x) AS g2, "
        f"quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM {dbl(src, c)}"))
    outl = per_column(cols, lambda c: (
        f"SELECT {lit(c)} AS col, count_if(d.x < b.q1 - 1.5 * (b.q3 - b.q1) OR d.x > b.q3 + 1.5 * (b.q3 - b.q1)) AS iqr_out "
        f"FROM {dbl(src, c, 'x')} d, (SELECT * FROM rows WHERE col = {lit(c)}) b WHERE d.x IS NOT NULL"))
    return f"rows AS ({body}),\nouts AS ({outl}),\n" + k2_sql("rows")


D2_SQL = fixture_cte("fx_signal") + ", " + _numstats_sql("fx_signal", SIGNAL_NUM) + """
SELECT k.col AS "column", round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std,
       round(coalesce(G1, 0), 4) AS skew, round(coalesce(G2, 0), 4) AS kurtosis, round(q1, 4) AS q1, round(q3, 4) AS q3,
       round(q3 - q1, 4) AS iqr, round(CAST(o.iqr_out AS DOUBLE) * 100 / n, 2) AS outlier_pct,
       exp(-k2 / 2) > 0.05 AS is_normal, round(exp(-k2 / 2), 4) AS normality_p
FROM k2 k JOIN outs o ON o.col = k.col"""


@register("d2_eda_numeric", D2_SQL)
def d2_eda_numeric(spark, sf):
    return D.eda_numeric(fixture(spark, sf, "fx_signal"), SIGNAL_NUM, with_shapiro=False)


# D3 ─────────────────────────────────────────────────────────────────────────
HIST_SQL = fixture_cte("fx_signal") + f""", lg AS ({_long('fx_signal', ['value', 'mixed'])}),
mm AS (SELECT col, min(x) AS vmin, max(x) AS vmax FROM lg WHERE x IS NOT NULL GROUP BY col),
b AS (SELECT l.col, m.vmin, m.vmax, CAST(CASE WHEN m.vmax = m.vmin THEN 0 ELSE least(floor((l.x - m.vmin) / ((m.vmax - m.vmin) / 10)), 9) END AS BIGINT) AS bin
      FROM lg l JOIN mm m ON m.col = l.col WHERE l.x IS NOT NULL)
SELECT col AS "column", bin, round(vmin + bin * ((vmax - vmin) / 10), 4) AS lower,
       round(vmin + (bin + 1) * ((vmax - vmin) / 10), 4) AS upper, count(*) AS count
FROM b GROUP BY col, bin, vmin, vmax"""


@register("d3_histogram", HIST_SQL)
def d3_histogram(spark, sf):
    return D.histogram(fixture(spark, sf, "fx_signal"), ["value", "mixed"], bins=10)


# D4 ─────────────────────────────────────────────────────────────────────────
KDE_SQL = fixture_cte("fx_signal") + f""", lg AS ({_long('fx_signal', ['value', 'mixed'])}),
st AS (SELECT col, min(x) AS vmin, max(x) AS vmax, count(x) AS n, stddev_samp(x) * pow(CAST(count(x) AS DOUBLE), -0.2) AS h
       FROM lg WHERE x IS NOT NULL GROUP BY col),
fine AS (SELECT l.col, CASE WHEN s.vmax = s.vmin THEN 0 ELSE least(floor((l.x - s.vmin) / ((s.vmax - s.vmin) / 1024)), 1023) END AS fb, count(*) AS cnt
         FROM lg l JOIN st s ON s.col = l.col WHERE l.x IS NOT NULL GROUP BY ALL),
centers AS (SELECT f.col, f.cnt, s.vmin + (f.fb + 0.5) * ((s.vmax - s.vmin) / 1024) AS cx FROM fine f JOIN st s ON s.col = f.col),
grid AS (SELECT s.col, s.n, s.h, g.j, s.vmin + g.j * (s.vmax - s.vmin) / 199 AS x FROM st s, range(0, 200) g(j))
SELECT g.col AS "column", CAST(g.j AS BIGINT) AS point, round(g.x, 4) AS x,
       round(sum(c.cnt * exp(-0.5 * ((g.x - c.cx) / g.h) * ((g.x - c.cx) / g.h))) / (g.n * g.h * sqrt(2 * pi())), 4) AS density
FROM grid g JOIN centers c ON c.col = g.col GROUP BY g.col, g.j, g.x, g.n, g.h"""


@register("d4_density_curve", KDE_SQL)
def d4_density_curve(spark, sf):
    return D.density_curve(fixture(spark, sf, "fx_signal"), ["value", "mixed"], points=200, grid_bins=1024)


# D5 ─────────────────────────────────────────────────────────────────────────
def _box_sql(lg_sql: str, g: list[str]) -> str:
    gs = ", ".join(g)
    on = " AND ".join(f"l.{x} = q.{x}" for x in g)
    return f"""lg AS ({lg_sql}),
q AS (SELECT {gs}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM lg WHERE x IS NOT NULL GROUP BY {gs})
SELECT {', '.join('l.' + x for x in g)}, count(*) AS n, round(q.q1, 4) AS q1, round(q.median, 4) AS median, round(q.q3, 4) AS q3,
       round(min(CASE WHEN l.x >= q.q1 - 1.5 * (q.q3 - q.q1) THEN l.x END), 4) AS whisker_low,
       round(max(CASE WHEN l.x <= q.q3 + 1.5 * (q.q3 - q.q1) THEN l.x END), 4) AS whisker_high,
       count_if(l.x < q.q1 - 1.5 * (q.q3 - q.q1) OR l.x > q.q3 + 1.5 * (q.q3 - q.q1)) AS n_outliers
FROM lg l JOIN q ON {on} WHERE l.x IS NOT NULL GROUP BY {', '.join('l.' + x for x in g)}, q.q1, q.median, q.q3"""


BOX_LG = ("SELECT 'value' AS \"column\", CAST(event_type AS VARCHAR) AS \"group\", x FROM (SELECT event_type, CAST(value AS DOUBLE) AS x FROM fx_signal) WHERE event_type IS NOT NULL "
          "UNION ALL SELECT 'value', '(all)', CAST(value AS DOUBLE) FROM fx_signal")


@register("d5_box_stats", fixture_cte("fx_signal") + ", " + _box_sql(BOX_LG, ['"column"', '"group"']))
def d5_box_stats(spark, sf):
    df = fixture(spark, sf, "fx_signal")
    return D.box_stats(df, ["value"], by="event_type").unionByName(D.box_stats(df, ["value"]))


# D6 ─────────────────────────────────────────────────────────────────────────
def _d6(c):
    return (f"SELECT {lit(c)} AS \"column\", round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, "
            f"round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 4) AS r "
            f"FROM (SELECT coalesce(CAST({qi(c)} AS DOUBLE), avg(CAST({qi(c)} AS DOUBLE)) OVER ()) AS x, CAST(net_price AS DOUBLE) AS y "
            f"FROM fx_price WHERE net_price IS NOT NULL)")


@register("d6_target_regression_line", fixture_cte("fx_price") + per_column(["l_quantity", "l_extendedprice", "l_discount"], _d6))
def d6_target_regression_line(spark, sf):
    return D.target_regression_line(fixture(spark, sf, "fx_price"), ["l_quantity", "l_extendedprice", "l_discount"], "net_price")


# D7 ─────────────────────────────────────────────────────────────────────────
CAT7 = fixture_cte("fx_status") + f""", lg AS ({_lab('fx_status', STATUS_CAT)}),
vc AS (SELECT col, value, count(*) AS cnt FROM lg WHERE value IS NOT NULL GROUP BY col, value),
tot AS (SELECT col, sum(cnt) AS n, count(*) AS u FROM vc GROUP BY col),
rk AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, value ASC) AS r FROM vc)"""


@register("d7_eda_categorical", CAT7 + """
SELECT rk.col AS "column", tot.u AS unique_values, rk.r AS rank, rk.value, round(CAST(rk.cnt AS DOUBLE) / tot.n, 4) AS share,
       round(max(CASE WHEN rk.r = 1 THEN CAST(rk.cnt AS DOUBLE) / tot.n END) OVER (PARTITION BY rk.col), 4) AS dominance
FROM rk JOIN tot ON tot.col = rk.col WHERE rk.r <= 10""")
def d7_eda_categorical(spark, sf):
    return D.eda_categorical(fixture(spark, sf, "fx_status"), STATUS_CAT, k=10)


# D8 ─────────────────────────────────────────────────────────────────────────
@register("d8_class_mix_by_category", fixture_cte("fx_status") + f""", lg AS ({_lab('fx_status', ['o_orderpriority', 'c_mktsegment'], ', CAST(o_orderstatus AS VARCHAR) AS class')}),
cnt AS (SELECT col, value, class, count(*) AS count FROM lg WHERE value IS NOT NULL AND class IS NOT NULL GROUP BY ALL),
lv AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) AS r FROM (SELECT DISTINCT col, value FROM cnt))
SELECT c.col AS "column", c.value, c.class, c.count, round(CAST(c.count AS DOUBLE) / sum(c.count) OVER (PARTITION BY c.col, c.value), 4) AS share
FROM cnt c JOIN lv ON lv.col = c.col AND lv.value = c.value WHERE lv.r <= 10""")
def d8_class_mix_by_category(spark, sf):
    return D.class_mix_by_category(fixture(spark, sf, "fx_status"), ["o_orderpriority", "c_mktsegment"], "o_orderstatus")


# D9 ─────────────────────────────────────────────────────────────────────────
D9_LG = """SELECT 'p_brand' AS feature, CAST(b.p_brand AS VARCHAR) AS "group", CAST(b.p_retailprice AS DOUBLE) AS x
FROM fx_brand b JOIN (SELECT p_brand FROM (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, CAST(p_brand AS VARCHAR)) AS r
                      FROM fx_brand WHERE p_brand IS NOT NULL GROUP BY p_brand) WHERE r <= 8) t ON t.p_brand = b.p_brand"""


@register("d9_target_by_top_categories", fixture_cte("fx_brand") + ", " + _box_sql(D9_LG, ["feature", '"group"']))
def d9_target_by_top_categories(spark, sf):
    return D.target_by_top_categories(fixture(spark, sf, "fx_brand"), ["p_brand"], "p_retailprice", k=8)


# D10–D12 ────────────────────────────────────────────────────────────────────
def _pairs(src, cols):
    return per_column(list(combinations(cols, 2)), lambda p: (
        f"SELECT {lit(p[0])} AS col_a, {lit(p[1])} AS col_b, "
        f"CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN greatest(-1.0, least(1.0, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)))) END AS r "
        f"FROM (SELECT CAST({qi(p[0])} AS DOUBLE) AS a, CAST({qi(p[1])} AS DOUBLE) AS b FROM {src}) WHERE a IS NOT NULL AND b IS NOT NULL"))


PAIRS = fixture_cte("fx_price") + f", pairs AS ({_pairs('fx_price', PRICE_NUM)})\n"


@register("d10_correlation_long", PAIRS + "SELECT col_a, col_b, round(r, 4) AS r FROM pairs")
def d10_correlation_long(spark, sf):
    return D.correlation_long(fixture(spark, sf, "fx_price"), PRICE_NUM)


TC_SQL = PAIRS + """, tc AS (SELECT col_a AS feature, round(abs(r), 4) AS abs_r,
  CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) < 0.05 THEN 'weak' ELSE 'moderate' END AS strength
  FROM pairs WHERE col_b = 'net_price')
"""


@register("d11_target_correlations", TC_SQL + "SELECT * FROM tc")
def d11_target_correlations(spark, sf):
    return D.target_correlations(fixture(spark, sf, "fx_price"), PRICE_NUM, "net_price")


@register("d12_collinear_pairs", PAIRS + "SELECT col_a, col_b, round(r, 2) AS r FROM pairs WHERE abs(r) > 0.85")
def d12_collinear_pairs(spark, sf):
    return D.collinear_pairs(fixture(spark, sf, "fx_price"), PRICE_NUM)


# D13–D16 ────────────────────────────────────────────────────────────────────
NULLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"]


@register("d13_missing_ranking", fixture_cte("fx_nulls") + "SELECT \"column\", round(f * 100, 2) AS missing_pct, f > 0.4 AS high_missing FROM ("
          + per_column(NULLS, lambda c: f"SELECT {lit(c)} AS \"column\", CAST(count_if({qi(c)} IS NULL) AS DOUBLE) / count(*) AS f FROM fx_nulls")
          + ") WHERE f > 0")
def d13_missing_ranking(spark, sf):
    return D.missing_ranking(P.column_basics(fixture(spark, sf, "fx_nulls")))


TD_SQL = """td AS (SELECT class, count, round(CAST(min(count) OVER () AS DOUBLE) / max(count) OVER (), 4) AS ratio,
        CAST(min(count) OVER () AS DOUBLE) / max(count) OVER () < 0.2 AS imbalanced
        FROM (SELECT CAST({t} AS VARCHAR) AS class, count(*) AS count FROM {src} WHERE {t} IS NOT NULL GROUP BY 1))"""


@register("d14_target_distribution", fixture_cte("fx_status") + ", " + TD_SQL.format(t="o_orderstatus", src="fx_status") + " SELECT * FROM td")
def d14_target_distribution(spark, sf):
    return D.target_distribution(fixture(spark, sf, "fx_status"), "o_orderstatus")


@register("d14_target_skew", fixture_cte("fx_price") + """
SELECT 'net_price' AS "column", round(skewness(x), 4) AS skew, abs(round(skewness(x), 4)) > 1 AS skewed
FROM (SELECT CAST(net_price AS DOUBLE) AS x FROM fx_price)""")
def d14_target_skew(spark, sf):
    return D.target_skew(fixture(spark, sf, "fx_price"), "net_price")


D15_NUM, D15_CAT = ["o_totalprice", "c_acctbal"], STATUS_CAT


@register("d15_describe_all", fixture_cte("fx_status") + per_column(D15_NUM, lambda c: (
    f"SELECT {lit(c)} AS \"column\", count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, "
    f"round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, "
    f"round(quantile_cont(x, 0.75), 4) AS p75, round(max(x), 4) AS max, CAST(NULL AS BIGINT) AS unique, "
    f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM {dbl('fx_status', c)}")) + "\nUNION ALL\n" + per_column(
    D15_CAT, lambda c: (
        f"SELECT {lit(c)}, CAST(sum(cnt) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), "
        f"first(v ORDER BY cnt DESC, v ASC), max(cnt) FROM (SELECT v, count(*) AS cnt FROM "
        f"(SELECT CAST({qi(c)} AS VARCHAR) AS v FROM fx_status) WHERE v IS NOT NULL GROUP BY v)")))
def d15_describe_all(spark, sf):
    return D.describe_all(fixture(spark, sf, "fx_status"), D15_NUM, D15_CAT)


INS_SQL = fixture_cte("fx_signal") + ", " + _numstats_sql("fx_signal", ["value", "mixed"]) + f""",
num AS (SELECT k.col, round(coalesce(G1, 0), 4) AS skew, round(CAST(o.iqr_out AS DOUBLE) * 100 / n, 2) AS outlier_pct,
        exp(-k2 / 2) > 0.05 AS is_normal, round(exp(-k2 / 2), 4) AS normality_p FROM k2 k JOIN outs o ON o.col = k.col),
lg AS ({_lab('fx_signal', ['event_type'])}),
vc AS (SELECT col, value, count(*) AS cnt FROM lg WHERE value IS NOT NULL GROUP BY col, value),
cat AS (SELECT col, count(*) AS u, round(CAST(max(cnt) AS DOUBLE) / sum(cnt), 4) AS dom FROM vc GROUP BY col),
{TD_SQL.format(t="big", src="fx_signal")}
SELECT col AS "column", 'skewed' AS code, skew AS value FROM num WHERE abs(skew) > 1
UNION ALL SELECT col, 'outliers', outlier_pct FROM num WHERE outlier_pct > 5
UNION ALL SELECT col, 'not_normal', normality_p FROM num WHERE NOT is_normal
UNION ALL SELECT col, 'near_constant', dom FROM cat WHERE dom > 0.9
UNION ALL SELECT col, 'high_cardinality', CAST(u AS DOUBLE) FROM cat WHERE u > 50
UNION ALL SELECT DISTINCT NULL, CASE WHEN imbalanced THEN 'imbalanced' ELSE 'balanced' END, ratio FROM td"""


@register("d16_eda_insights", INS_SQL)
def d16_eda_insights(spark, sf):
    df = fixture(spark, sf, "fx_signal")
    num = D.eda_numeric(df, ["value", "mixed"], with_shapiro=False)
    cat = D.eda_categorical(df, ["event_type"], k=10)
    return D.eda_insights(num, cat, None, None, None, D.target_distribution(df, "big"))
