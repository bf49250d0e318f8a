"""Exact quantiles by selection between sketched brackets: near-unique columns are never shuffled.

1. One aggregation, combined map-side, gives each group's size and a mergeable quantile sketch, whose rank error is at most
   n / ``accuracy``. The sketch is asked a little below and above each wanted rank, which brackets the exact value.
2. A second pass counts the rows below each bracket and, by value, those inside it: about 4 n / ``accuracy`` rows, and one
   row for a value that many rows share. Only these are shuffled.
3. The wanted positions are found among the counted values (in ordered buckets, if a bracket holds very many).

Whether every bracket holds its positions is checked against the counts; else the quantiles are taken from all value counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tabprobe.functions.joins import bounded_broadcast
from tabprobe.operators import ranks

ACCURACY = 10_000


def bracketed_quantiles(long_df: DataFrame, probs: Sequence[float], group_cols: Sequence[str] = ("column",),
                        rows_per_bucket: int = ranks.ROWS_PER_BUCKET, accuracy: int = ACCURACY) -> DataFrame:
    """Exact linear-interpolated quantiles ``(group..., p, q)`` of the non-null values of each group."""
    g, probs = list(group_cols), [float(p) for p in probs]
    rows = long_df.where(F.col("value").isNotNull()).select(*g, "value")
    ask = [min(1.0, max(0.0, p + s * 2.0 / accuracy)) for p in probs for s in (-1, 1)]
    sketch = rows.groupBy(*g).agg(F.count("*").alias("n"), F.percentile_approx("value", ask, accuracy).alias("e"))
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.col("e")[2 * i].alias("low"), F.col("e")[2 * i + 1].alias("high")) for i, p in enumerate(probs)])
    sketch = sketch.select(*g, "n", each.alias("b")).persist(StorageLevel.MEMORY_AND_DISK)
    n_groups = sketch.count()
    met = rows.join(bounded_broadcast(sketch.select(*g, "b"), n_groups), g)
    at = F.transform(F.filter("b", lambda b: F.col("value") <= b["high"]),
                     lambda b: F.struct(b["p"].alias("p"), F.when(F.col("value") >= b["low"], F.col("value")).alias("value")))
    # a NULL value stands for all rows below the bracket
    counts = met.select(*g, F.inline(at)).groupBy(*g, "p", "value").agg(F.count("*").alias("t")).persist(StorageLevel.MEMORY_AND_DISK)
    wanted = sketch.select(*g, "n", F.explode("b.p").alias("p")).withColumn("pos", F.col("p") * (F.col("n") - 1)).select(
        *g, "p", F.floor("pos").alias("lo"), F.ceil("pos").alias("hi"), (F.col("pos") - F.floor("pos")).alias("frac"))
    inside = F.col("value").isNotNull()
    held = counts.groupBy(*g, "p").agg(F.coalesce(F.sum(F.when(~inside, F.col("t"))), F.lit(0)).alias("below"),
                                       F.coalesce(F.sum(F.when(inside, F.col("t"))), F.lit(0)).alias("held"), F.count("value").alias("d"))
    aims = wanted.join(held, [*g, "p"], "left")
    ok = (F.col("below") <= F.col("lo")) & (F.col("hi") < F.col("below") + F.col("held"))
    size = aims.agg(F.max("d").alias("d"), F.count("*").alias("g"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad")).first()
    if size["bad"]:
        counts.unpersist()
        return ranks.quantiles(long_df, probs, g, rows_per_bucket=rows_per_bucket)
    at = ranks.with_positions(counts.where(inside), [*g, "p"], (int(size["d"] or 0), int(size["g"] or 0)), rows_per_bucket)
    hit = at.drop("n").join(bounded_broadcast(aims.select(*g, "p", "lo", "hi", "frac", "below"), int(size["g"] or 0)), [*g, "p"])
    first = F.col("below") + F.col("start")
    in_lo = (F.col("lo") >= first) & (F.col("lo") < first + F.col("t"))
    in_hi = (F.col("hi") >= first) & (F.col("hi") < first + F.col("t"))
    two = hit.groupBy(*g, "p").agg(F.max(F.when(in_lo, F.col("value"))).alias("v0"), F.max(F.when(in_hi, F.col("value"))).alias("v1"),
                                   F.max("frac").alias("frac"))
    return two.select(*g, "p", (F.col("v0") + F.col("frac") * (F.col("v1") - F.col("v0"))).alias("q"))


def bracketed_wide(long_df: DataFrame, probs: dict[str, float], group_cols: Sequence[str] = ("column",), **options) -> DataFrame:
    """Quantiles pivoted to one column per name, e.g. ``{"q1": .25, "median": .5, "q3": .75}``."""
    return ranks.pivot_quantiles(bracketed_quantiles(long_df, list(probs.values()), group_cols, **options), probs, group_cols)
