"""Plan checks: no single-partition exchange under row-level windows; top-k limited before the shuffle;
scans read only the needed columns."""

from tabprobe.operators import profile as P
from tabprobe.operators import ranks
from tabprobe.operators.longform import numeric_long

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.collect()  # AQE final plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_and_quantile_windows_are_partitioned(spark):
    lg = numeric_long(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_quantity", "l_extendedprice"])
    for df in (ranks.rank_table(lg, ["column"], rows_per_bucket=500),
               ranks.quantiles(lg, [0.25, 0.5], rows_per_bucket=500)):
        plan = _plan(df)
        assert "SinglePartition" not in plan, plan


def test_top_k_uses_window_group_limit(spark):
    counts = P.label_counts(spark.read.parquet(f"{SF}/orders.parquet"), ["o_orderpriority", "o_orderstatus"])
    top = P.top_values(counts, 3)
    top.collect()
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan, plan


def test_scan_prunes_columns(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    lg = numeric_long(df, ["l_quantity"])
    plan = lg._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_quantity" in plan, plan
