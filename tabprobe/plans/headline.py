"""Headline workloads for bench.py: each runs one block end to end on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.operators import eda as D
from tabprobe.operators import profile as P
from tabprobe.operators import quality as Q
from tabprobe.operators import stats as S
from tabprobe.sources.tables import fixture, table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_profile_lineitem(spark, sf):
    """Full column profile of lineitem."""
    return P.profile_columns(table(spark, sf, "lineitem")).collect()


def q_quality_orders(spark, sf):
    """Duplicates, co-missing pairs and Pearson flags (C)."""
    df = fixture(spark, sf, "fx_nulls")
    Q.duplicate_rows(df).collect()
    Q.co_missing_pairs(df, ["o_totalprice", "o_orderpriority"]).collect()
    return Q.pearson_flags(Q.pearson_pairs(fixture(spark, sf, "fx_price"), LI_NUM + ["net_price"])).collect()


def q_eda_lineitem(spark, sf):
    """Histograms, box stats by return flag and the KDE grid (D)."""
    df = table(spark, sf, "lineitem")
    D.histogram(df, LI_NUM, 20).collect()
    D.box_stats(df, LI_NUM, by="l_returnflag").collect()
    return D.density_curve(df, ["l_extendedprice"], 200).collect()


def q_tests_classification(spark, sf):
    """Test router on a 3-class target over orders ⋈ customer."""
    return S.test_features(fixture(spark, sf, "fx_status"), "o_orderstatus", "classification").collect()


def q_tests_regression(spark, sf):
    """Pearson / Spearman / Kruskal router on a regression target."""
    return S.test_features(fixture(spark, sf, "fx_price"), "net_price", "regression").collect()


def q_mutual_information(spark, sf):
    """Binned mutual information of every lineitem feature with the return flag."""
    df = table(spark, sf, "lineitem")
    return S.mutual_information(df, LI_NUM, ["l_linestatus"], "l_returnflag").collect()


QUERIES = {
    "profile_lineitem": q_profile_lineitem,
    "quality_orders": q_quality_orders,
    "eda_lineitem": q_eda_lineitem,
    "tests_classification": q_tests_classification,
    "tests_regression": q_tests_regression,
    "mutual_information": q_mutual_information,
}
