"""Distinct-count sketches that can be stored and merged: HyperLogLog states a column, in partitions or days.

A state is a few kilobytes whatever the column holds, is made map-side and merged with others of its column, so a day's
rows are read once and any span of days is answered from states. Exact counts stay the default of the profile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.columns import c
from tabprobe.operators.longform import melt

#: 2 ** LG_K registers; the standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 14


def distinct_states(df: DataFrame, cols: Sequence[str], by: str | None = None, lg_k: int = LG_K) -> DataFrame:
    """``column[, part], state, n`` for each column, and for each value of ``by`` (cast to text) where it is given.

    Values meet as 64-bit hashes, so every type has a state; NULLs are not counted (a column of NULLs has a state of 0).
    """
    keep = [] if by is None else [by]
    lg = melt(df, cols, lambda d, x: F.when(c(x).isNotNull(), F.xxhash64(c(x))), keep=keep, value_type="bigint")
    keys: list[Column] = [F.col("column")] + ([] if by is None else [c(by).cast("string").alias("part")])
    return lg.groupBy(*keys).agg(F.hll_sketch_agg("value", lg_k).alias("state"), F.count("value").alias("n"))


def merged_states(*states: DataFrame, keep_parts: bool = False) -> DataFrame:
    """``column[, part], state, n``: states of a column (and part) from any number of tables as one."""
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    keys = ["column", "part"] if keep_parts else ["column"]
    return rows.groupBy(*keys).agg(F.hll_union_agg("state").alias("state"), F.sum("n").alias("n"))


def distinct_estimates(states: DataFrame) -> DataFrame:
    """The estimate ``approx_distinct`` of each state."""
    return states.select(*[x for x in states.columns if x not in ("state", "n")], F.hll_sketch_estimate("state").alias("approx_distinct"), "n")
