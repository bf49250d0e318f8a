"""Connected components by alternating large-star and small-star steps, each a few joins over slim edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import salted_lookup, written


def _to_smallest(edges: DataFrame, keep_node: bool) -> DataFrame:
    """For each node the smallest of itself and its neighbours; its neighbours (and itself) are linked to that."""
    low = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = salted_lookup(edges, low, ["a"], "inner", salts=8).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if keep_node:
        moved = moved.unionByName(low.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``v, label`` for all nodes of ``edges`` (longs ``a, b``): label is the smallest node of the component.

    A step keeps components and shrinks paths; it ends when the edges are stars around the smallest nodes, after a
    number of rounds logarithmic in a component's length. Each round is a written table.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    sign = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the smallest one; small star: smaller neighbours and the node do
        large = salted_lookup(both, low, ["a"], "inner", salts=8).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        now = written(_to_smallest(large, keep_node=True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == sign:
            return now.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(
                now.select(F.col("b").alias("v"), F.col("b").alias("label"))).distinct()
        sign = tuple(row)
    raise RuntimeError("components did not settle")
