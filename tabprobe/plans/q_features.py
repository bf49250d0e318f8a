"""Registered queries for feature preparation (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.functions.columns import as_double, r4, rnd
from tabprobe.functions.keyhash import is_test, sql_fold, sql_is_test
from tabprobe.operators import features as X
from tabprobe.operators import profile as P
from tabprobe.operators import quality as Q
from tabprobe.operators import stats as S
from tabprobe.plans import rules
from tabprobe.plans.q_profile import FE_SQL, SHAPES_PROF
from tabprobe.plans.registry import register
from tabprobe.plans.signals import measured_signals
from tabprobe.sources.tables import fixture, fixture_cte, table


def _shapes_profile(spark, sf):
    return P.profile_columns(fixture(spark, sf, "fx_shapes"), with_shapiro=False)


@register("f1_plan_from_profile", SHAPES_PROF + """
SELECT "column", CASE suggested_transform WHEN 'drop' THEN 'drop' WHEN 'cyclical' THEN 'decompose'
       WHEN 'target_encode' THEN 'encode' ELSE 'transform' END AS action,
       CASE WHEN suggested_transform = 'drop' THEN NULL ELSE suggested_transform END AS method, reason
FROM (""" + FE_SQL.format(target="flag") + ") WHERE suggested_transform IS NOT NULL")
def f1_plan_from_profile(spark, sf):
    return rules.plan_from_profile(Q.fe_recommendations(_shapes_profile(spark, sf), target="flag"))


@register("f2_normalise_plan")
def f2_normalise_plan(spark, sf):
    """Rule plan of fx_shapes merged with a user plan that keeps ``skewed`` and bins ``user_id``."""
    df = fixture(spark, sf, "fx_shapes")
    base = rules.plan_dict(rules.plan_from_profile(Q.fe_recommendations(_shapes_profile(spark, sf), target="flag")))
    merged, inter = rules.normalise_plan(df, base, {"skewed": {"action": "keep"},
                                                     "user_id": {"action": "transform", "method": "bin_quantile"}},
                                         [{"col_a": "skewed", "col_b": "user_id", "type": "ratio"}])
    rows = [(k, v["action"], v["method"], v["reason"]) for k, v in merged.items()]
    return spark.createDataFrame(rows, "column string, action string, method string, reason string")


@register("f5_cyclical_datetime", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
       CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek,
       round(sin(2 * pi() * month(o_orderdate) / 12), 4) + 0.0 AS o_orderdate_month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 4) + 0.0 AS o_orderdate_month_cos,
       round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 4) + 0.0 AS o_orderdate_dow_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 4) + 0.0 AS o_orderdate_dow_cos
FROM orders""")
def f5_cyclical_datetime(spark, sf):
    d = X.cyclical_datetime(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"])
    return d.select(*[r4(F.col(x)).alias(x) if x.endswith(("_sin", "_cos")) else F.col(x) for x in d.columns])


@register("f6_impute_median", fixture_cte("fx_nulls") + """
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM fx_nulls)), 4) AS o_totalprice FROM fx_nulls""")
def f6_impute_median(spark, sf):
    df = fixture(spark, sf, "fx_nulls")
    m = X.medians(df, ["o_totalprice"])
    out = X.FeatureModel("o_orderstatus", ["o_orderkey"], medians=m).transform(df.select("o_orderkey", "o_totalprice"))
    return out.select("o_orderkey", r4(F.col("o_totalprice")).alias("o_totalprice"))


@register("f7_impute_mode", fixture_cte("fx_nulls") + """
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT first(v ORDER BY cnt DESC, v) FROM
       (SELECT o_orderpriority AS v, count(*) AS cnt FROM fx_nulls WHERE o_orderpriority IS NOT NULL GROUP BY 1))) AS o_orderpriority
FROM fx_nulls""")
def f7_impute_mode(spark, sf):
    df = fixture(spark, sf, "fx_nulls")
    m = X.modes(df, ["o_orderpriority"])
    return X.impute(df.select("o_orderkey", "o_orderpriority"), {}, m)


@register("f8_log1p_transform", fixture_cte("fx_shapes") + "SELECT event_id, round(ln(1 + skewed), 4) AS skewed FROM fx_shapes")
def f8_log1p_transform(spark, sf):
    df = fixture(spark, sf, "fx_shapes").select("event_id", "skewed")
    out = X.FeatureModel("t", ["event_id"], transforms=[("skewed", "log1p", None)]).transform(df)
    return out.select("event_id", r4(F.col("skewed")).alias("skewed"))


@register("f9_sqrt_transform", fixture_cte("fx_shapes") + "SELECT event_id, round(sqrt(skewed), 4) AS skewed FROM fx_shapes")
def f9_sqrt_transform(spark, sf):
    df = fixture(spark, sf, "fx_shapes").select("event_id", "skewed")
    out = X.FeatureModel("t", ["event_id"], transforms=[("skewed", "sqrt", None)]).transform(df)
    return out.select("event_id", r4(F.col("skewed")).alias("skewed"))


@register("f10_yeo_johnson")
def f10_yeo_johnson(spark, sf):
    """λ by maximum likelihood on ``skewed_neg`` (grid rounds of one aggregation each), then the transform."""
    df = fixture(spark, sf, "fx_shapes").select("event_id", "skewed_neg")
    lam = X.yeo_johnson_lambda(df, "skewed_neg")
    out = X.FeatureModel("t", ["event_id"], transforms=[("skewed_neg", "yeo_johnson", lam)]).transform(df)
    return out.withColumn("lambda", F.lit(lam))


@register("f11_winsorize", fixture_cte("fx_shapes") + """,
b AS (SELECT quantile_cont(skewed, 0.25) AS q1, quantile_cont(skewed, 0.75) AS q3 FROM fx_shapes)
SELECT event_id, round(least(greatest(skewed, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 4) AS skewed FROM fx_shapes, b""")
def f11_winsorize(spark, sf):
    df = fixture(spark, sf, "fx_shapes").select("event_id", "skewed")
    b = X.iqr_bounds(df, ["skewed"])["skewed"]
    out = X.FeatureModel("t", ["event_id"], transforms=[("skewed", "winsorize", b)]).transform(df)
    return out.select("event_id", r4(F.col("skewed")).alias("skewed"))


@register("f12_bin_quantile", fixture_cte("fx_shapes") + """,
e AS (SELECT quantile_cont(skewed, 0.0) AS e0, quantile_cont(skewed, 0.2) AS e1, quantile_cont(skewed, 0.4) AS e2,
             quantile_cont(skewed, 0.6) AS e3, quantile_cont(skewed, 0.8) AS e4, quantile_cont(skewed, 1.0) AS e5 FROM fx_shapes)
SELECT event_id, CASE WHEN skewed IS NULL OR skewed < e0 OR skewed > e5 THEN NULL WHEN skewed <= e1 THEN 0.0
       WHEN skewed <= e2 THEN 1.0 WHEN skewed <= e3 THEN 2.0 WHEN skewed <= e4 THEN 3.0 ELSE 4.0 END AS skewed
FROM fx_shapes, e""")
def f12_bin_quantile(spark, sf):
    df = fixture(spark, sf, "fx_shapes").select("event_id", "skewed")
    edges = X.qcut_edges(df, "skewed")
    return X.FeatureModel("t", ["event_id"], transforms=[("skewed", "bin_quantile", edges)]).transform(df)


@register("f14_interactions", fixture_cte("fx_price") + """
SELECT round(l_extendedprice, 4) AS l_extendedprice, round(l_quantity, 4) AS l_quantity,
       round(coalesce(l_extendedprice / CASE WHEN l_quantity <> 0 THEN l_quantity END, 0.0), 4) AS l_extendedprice_div_l_quantity,
       round(l_extendedprice * l_quantity, 4) AS l_extendedprice_x_l_quantity,
       round(l_extendedprice - l_quantity, 4) AS l_extendedprice_minus_l_quantity FROM fx_price""")
def f14_interactions(spark, sf):
    df = fixture(spark, sf, "fx_price").select("l_extendedprice", "l_quantity")
    inter = [("l_extendedprice", "l_quantity", k) for k in ("ratio", "product", "difference")]
    out = X.FeatureModel("t", [], interactions=inter).transform(df)
    return out.select(*[r4(F.col(x)).alias(x) for x in out.columns])


TE_SQL = fixture_cte("fx_brand") + f""",
d AS (SELECT p_partkey, CAST(p_brand AS VARCHAR) AS lvl, CAST(p_retailprice AS DOUBLE) AS y, {sql_fold('p_partkey', 5)} AS fold FROM fx_brand),
bf AS (SELECT lvl, fold, sum(y) AS s, count(*) AS c FROM d WHERE y IS NOT NULL GROUP BY lvl, fold),
tot AS (SELECT lvl, sum(s) AS S, sum(c) AS C FROM bf GROUP BY lvl),
oof AS (SELECT bf.lvl, bf.fold, CASE WHEN tot.C - bf.c <> 0 THEN (tot.S - bf.s) / (tot.C - bf.c) END AS te FROM bf JOIN tot USING (lvl)),
gm AS (SELECT avg(y) AS g FROM d WHERE y IS NOT NULL)
SELECT d.p_partkey, round(coalesce(oof.te, gm.g), 4) AS p_brand_te FROM d LEFT JOIN oof ON oof.lvl = d.lvl AND oof.fold = d.fold, gm"""


@register("f17_target_encode", TE_SQL)
def f17_target_encode(spark, sf):
    df = fixture(spark, sf, "fx_brand").select("p_partkey", "p_brand", "p_retailprice")
    fitted = X.target_encode_fit(df, "p_brand", "p_retailprice", ["p_partkey"])
    out = X.target_encode_train(df, "p_brand", ["p_partkey"], fitted)
    return out.select("p_partkey", r4(F.col("p_brand_te")).alias("p_brand_te"))


@register("f18_frequency_encode", fixture_cte("fx_brand") + """
SELECT p_partkey, round(coalesce(f, 0.0), 4) AS p_brand_freq FROM fx_brand LEFT JOIN
  (SELECT CAST(p_brand AS VARCHAR) AS lvl, CAST(count(*) AS DOUBLE) / (SELECT count(p_brand) FROM fx_brand) AS f FROM fx_brand
   WHERE p_brand IS NOT NULL GROUP BY 1) t ON t.lvl = CAST(p_brand AS VARCHAR)""")
def f18_frequency_encode(spark, sf):
    df = fixture(spark, sf, "fx_brand").select("p_partkey", "p_brand")
    table_, levels = X.frequency_table(df, "p_brand")
    out = X.frequency_encode(df, "p_brand", table_, levels)
    return out.select("p_partkey", r4(F.col("p_brand_freq")).alias("p_brand_freq"))


@register("f19_one_hot", fixture_cte("fx_status") + """
SELECT o_orderkey, """ + ", ".join(
    f"coalesce(CAST(CAST(o_orderpriority AS VARCHAR) = '{lv}' AS DOUBLE), 0.0) AS \"o_orderpriority_{lv}\""
    for lv in ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + " FROM fx_status")
def f19_one_hot(spark, sf):
    df = fixture(spark, sf, "fx_status").select("o_orderkey", "o_orderpriority")
    levels = X.one_hot_levels(df, "o_orderpriority")
    return df.withColumns(X.one_hot_exprs("o_orderpriority", levels)).drop("o_orderpriority")


PRICE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross_price", "net_price"]


@register("f20_standardise", fixture_cte("fx_price") + "SELECT " + ", ".join(
    f"round((CAST({x} AS DOUBLE) - (SELECT avg({x}) FROM fx_price)) / (SELECT CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1 END FROM fx_price), 3) + 0.0 AS {x}"
    for x in PRICE_NUM) + " FROM fx_price")
def f20_standardise(spark, sf):
    df = fixture(spark, sf, "fx_price").select(*PRICE_NUM)
    sc = X.scaler_params(df, PRICE_NUM)
    # 3 dp: the two engines' means differ in the last bits, which flips some 4th decimals
    return df.select(*[rnd((as_double(df, x) - sc[x][0]) / sc[x][1], 3).alias(x) for x in PRICE_NUM])


@register("f23_residual_types", """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(epoch_us(o_orderdate) AS DOUBLE) AS o_orderdate FROM orders""")
def f23_residual_types(spark, sf):
    return X.residual_types(table(spark, sf, "orders"), keep=["o_orderkey", "o_custkey"])


# ── whole fit / apply (rows-only: many fitted steps) ─────────────────────────

def _status_model(spark, sf):
    df = fixture(spark, sf, "fx_status")
    train = df.where(~is_test(F.col("o_orderkey")))
    prof = P.profile_columns(train, target="o_orderstatus", with_shapiro=False)
    signals, pairs = measured_signals(train, "o_orderstatus", ["o_orderkey"], "classification")
    model = X.fit(train, "o_orderstatus", ["o_orderkey"], profile=prof, signals=signals, collinear_pairs=pairs)
    return df, train, model


@register("f22_apply_model")
def f22_apply_model(spark, sf):
    """Fit on the training split of fx_status, apply every fitted step to the held-out rows."""
    df, _, model = _status_model(spark, sf)
    return model.transform(df.where(is_test(F.col("o_orderkey"))))


@register("f21_feature_report")
def f21_feature_report(spark, sf):
    df, _, model = _status_model(spark, sf)
    return X.feature_report(model, len(df.columns) - 1, spark)


@register("f13_auto_transforms")
def f13_auto_transforms(spark, sf):
    """Rule path on fx_shapes: winsorize heavy-outlier columns, log1p / Yeo-Johnson skewed ones."""
    df = fixture(spark, sf, "fx_shapes")
    prof = P.profile_columns(df, target="flag", with_shapiro=False)
    model = X.fit(df, "flag", ["event_id"], profile=prof)
    rows = [(x, meth, str(p)) for x, meth, p in model.transforms]
    return spark.createDataFrame(rows, "column string, method string, params string")


@register("f3_drop_columns")
def f3_drop_columns(spark, sf):
    """Drop decisions (plan, constant / id, mostly missing, high missing without signal) on fx_nulls."""
    df = fixture(spark, sf, "fx_nulls")
    prof = P.profile_columns(df, target="o_orderstatus", with_shapiro=False)
    signals, _ = measured_signals(df, "o_orderstatus", ["o_orderkey"], "classification")
    model = X.fit(df, "o_orderstatus", ["o_orderkey"], profile=prof, signals=signals, plan={"o_custkey": {"action": "drop"}})
    return spark.createDataFrame([(x, a, r) for x, a, _, r in model.steps if a == "drop"],
                                 "column string, action string, reason string")


@register("f16_resolve_collinearity")
def f16_resolve_collinearity(spark, sf):
    """Collinear pairs of fx_price (|r| > 0.85) resolved by (significant, |r|, effect) priority."""
    df = fixture(spark, sf, "fx_price")
    num = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross_price"]
    pairs = [(r["col_a"], r["col_b"]) for r in Q.pearson_pairs(df, num).where(F.abs("r") > 0.85).collect()]
    tests = S.test_features(df.select(*num, "net_price"), "net_price", "regression").select(
        "feature", "significant_after_fdr", "effect_label", "effect_size", F.abs("statistic").alias("abs_r"))
    model = X.fit(df.select(*num, "net_price"), "net_price", [], signals=tests, collinear_pairs=pairs)
    return spark.createDataFrame([(x, r) for x, a, _, r in model.steps if a == "drop"], "column string, reason string")


@register("f15_drop_low_signal")
def f15_drop_low_signal(spark, sf):
    """Low-signal features of fx_signal dropped once something is FDR-significant."""
    df = fixture(spark, sf, "fx_signal")
    signals, _ = measured_signals(df, "big", ["event_id"], "classification")
    model = X.fit(df, "big", ["event_id"], signals=signals)
    return spark.createDataFrame([(x, r) for x, a, _, r in model.steps if a == "drop"] or [("", "none")],
                                 "column string, reason string")
