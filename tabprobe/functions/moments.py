"""Moment conversions and normality statistics.

Spark's ``skewness``/``kurtosis`` are population values (g1, g2). pandas and
scipy report the bias-corrected G1/G2; the D'Agostino-Pearson K² test uses the
population values. All formulas below are the published ones.

K² is built in stages (one projection per intermediate) so that the optimizer
keeps each intermediate as a column instead of inlining a deep expression tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_skew(g1: Column, n: Column) -> Column:
    """G1 = g1·sqrt(n(n−1))/(n−2); NULL for n < 3, 0 when the variance is 0."""
    n = n.cast("double")
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(g1.isNull(), F.lit(0.0))
            .otherwise(F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)))


def sample_kurt(g2: Column, n: Column) -> Column:
    """G2 = (n−1)/((n−2)(n−3))·((n+1)g2 + 6); NULL for n < 4, 0 when the variance is 0."""
    n = n.cast("double")
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(g2.isNull(), F.lit(0.0))
            .otherwise(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def with_dagostino(df: DataFrame, g1: str = "g1", g2: str = "g2", n: str = "n", out: str = "k2") -> DataFrame:
    """Add ``out`` = Zs² + Zk² (D'Agostino 1970 skew score, Anscombe & Glynn 1983 kurtosis score)."""
    N = F.when(F.col(n) >= 8, F.col(n).cast("double"))  # NULL below 8 values: the skew score needs them (w² is 1 at 7)
    s = df.withColumns({
        "__y": F.col(g1) * F.sqrt((N + 1) * (N + 3) / (6.0 * (N - 2))),
        "__beta2": 3.0 * (N * N + 27 * N - 70) * (N + 1) * (N + 3) / ((N - 2) * (N + 5) * (N + 7) * (N + 9)),
        "__b2": F.col(g2) + 3,
        "__e": 3.0 * (N - 1) / (N + 1),
        "__varb2": 24.0 * N * (N - 2) * (N - 3) / ((N + 1) * (N + 1) * (N + 3) * (N + 5)),
        "__sb1": 6.0 * (N * N - 5 * N + 2) / ((N + 7) * (N + 9)) * F.sqrt(6.0 * (N + 3) * (N + 5) / (N * (N - 2) * (N - 3))),
    })
    s = s.withColumns({"__w2": F.sqrt(2 * (F.col("__beta2") - 1)) - 1,
                       "__x": (F.col("__b2") - F.col("__e")) / F.sqrt("__varb2"),
                       "__a": 6.0 + 8.0 / F.col("__sb1") * (2.0 / F.col("__sb1") + F.sqrt(1 + 4.0 / (F.col("__sb1") * F.col("__sb1")))),
                       "__y": F.when(F.col("__y") == 0, F.lit(1.0)).otherwise(F.col("__y"))})
    s = s.withColumns({"__delta": 1 / F.sqrt(0.5 * F.log("__w2")),
                       "__ya": F.col("__y") / F.sqrt(2.0 / (F.col("__w2") - 1)),
                       "__denom": 1 + F.col("__x") * F.sqrt(2 / (F.col("__a") - 4.0))})
    s = s.withColumns({"__zs": F.col("__delta") * F.log(F.col("__ya") + F.sqrt(F.col("__ya") * F.col("__ya") + 1)),
                       "__zk": F.when(F.col("__denom") == 0, F.lit(None).cast("double")).otherwise(
                           ((1 - 2 / (9.0 * F.col("__a")))
                            - F.signum("__denom") * F.pow((1 - 2.0 / F.col("__a")) / F.abs("__denom"), F.lit(1 / 3.0)))
                           / F.sqrt(2 / (9.0 * F.col("__a"))))})
    s = s.withColumn(out, F.col("__zs") * F.col("__zs") + F.col("__zk") * F.col("__zk"))
    return s.drop(*[x for x in s.columns if x.startswith("__")])


def chi2_sf_2dof(x: Column) -> Column:
    """Survival function of chi² with 2 degrees of freedom: exp(−x/2)."""
    return F.exp(-x / 2)
