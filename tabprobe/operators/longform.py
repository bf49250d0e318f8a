"""Wide → long reshaping, the Spark form of "for each column".

A per-column statistic is one ``groupBy("column")`` over ``(column, value)``
rows instead of one job per column. Algebraic aggregates (count, sums,
moments) combine map-side, so the shuffle carries one row per column per
task no matter how many rows a column holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.columns import as_double, as_label, c


def melt(
    df: DataFrame,
    cols: Sequence[str],
    value: Callable[[DataFrame, str], Column] = as_double,
    keep: Sequence[str] = (),
    value_type: str = "double",
) -> DataFrame:
    """``(keep..., column, value)`` rows, one per input row and column."""
    cols = list(cols)
    keep_cols = [c(k) for k in keep]
    if not cols:
        empty = df.limit(0).select(*keep_cols, F.lit(None).cast("string").alias("column"),
                                    F.lit(None).cast(value_type).alias("value"))
        return empty
    pairs = F.array(*[
        F.struct(F.lit(name).alias("column"), value(df, name).cast(value_type).alias("value"))
        for name in cols
    ])
    return df.select(*keep_cols, F.inline(pairs))


def numeric_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return melt(df, cols, as_double, keep, "double")


def label_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return melt(df, cols, as_label, keep, "string")
