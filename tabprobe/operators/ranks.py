"""Exact average ranks and exact quantiles from value counts, without a global sort.

Everything starts from ``value_counts``: one row per (group, distinct value)
with its row count ``t`` — one shuffle of the input, combined map-side, so a
value that holds a third of all rows is a single row. Distinct values are then
cut into ordered buckets by approximate quantile edges of the distinct values
(a bounded sketch per group); bucket totals give each bucket's offset (a tiny
table), and a window *partitioned by (group, bucket)* gives the running count
inside a bucket. No task sorts more than one bucket of distinct values, and the
number of buckets grows with the data (``rows_per_bucket``).

* start     = rows of the group with a smaller value (0-based position)
* avg_rank  = start + (t + 1) / 2          (ties get the average rank)
* quantile p at position p·(n−1), linear between the two neighbours, which is
  pandas' default and DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.joins import bounded_broadcast

ROWS_PER_BUCKET = 2_000_000
# ranks of at most so many values are looked up from a broadcast table
FEW_VALUES = 100_000


def value_counts(long_df: DataFrame, group_cols: Sequence[str] = ("column",)) -> DataFrame:
    """``(group..., value, t)`` for the non-null values of each group."""
    return (long_df.where(F.col("value").isNotNull())
            .groupBy(*group_cols, "value").agg(F.count("*").alias("t")))


def distinct_sizes(vc: DataFrame, group_cols: Sequence[str]) -> tuple[int, int]:
    """(most distinct values in a group, number of groups) — one small job over the counts."""
    row = vc.groupBy(*group_cols).count().agg(F.max("count").alias("m"), F.count("*").alias("g")).first()
    return int(row["m"] or 0), int(row["g"] or 0)


def bucket_count(d_max: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets a group of ``d_max`` distinct values is cut into."""
    return max(1, math.ceil(d_max / max(rows_per_bucket, 1)))


def assign_buckets(vc: DataFrame, group_cols: Sequence[str], d_max: int,
                   rows_per_bucket: int = ROWS_PER_BUCKET, accuracy: int = 10_000) -> DataFrame:
    """Add ``bucket``: ordered ranges of distinct values, ≈ ``rows_per_bucket`` values each.

    The sketch's accuracy follows the bucket count, so an edge is off by at most a tenth of a bucket.
    """
    buckets = bucket_count(d_max, rows_per_bucket)
    if buckets <= 1:
        return vc.withColumn("bucket", F.lit(0))
    probs = [k / buckets for k in range(1, buckets)]
    sk = vc.groupBy(*group_cols).agg(
        F.percentile_approx("value", probs, max(accuracy, 10 * buckets)).alias("edges"))
    rows = []
    for r in sk.collect():  # one row per group, `buckets` numbers each
        key = tuple(r[g] for g in group_cols)
        edges = sorted(set(float(e) for e in r["edges"] if e is not None))
        bounds = [None] + edges + [None]
        for b in range(len(bounds) - 1):
            rows.append(key + (b, bounds[b], bounds[b + 1]))
    schema = ", ".join([f"`{g}` {vc.schema[g].dataType.simpleString()}" for g in group_cols]
                       + ["bucket int", "lo double", "hi double"])
    edf = vc.sparkSession.createDataFrame(rows, schema).withColumnsRenamed({g: f"__e_{g}" for g in group_cols})
    e = bounded_broadcast(edf, len(rows))
    cond = (e["lo"].isNull() | (vc["value"] >= e["lo"])) & (e["hi"].isNull() | (vc["value"] < e["hi"]))
    for g in group_cols:
        cond = (vc[g] == e[f"__e_{g}"]) & cond
    return vc.join(e, cond, "inner").drop(*[f"__e_{g}" for g in group_cols], "lo", "hi")


def bucket_offsets(vcb: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``(group..., bucket, bt, off, n)`` — tiny: groups × buckets rows."""
    bt = vcb.groupBy(*group_cols, "bucket").agg(F.sum("t").alias("bt"))
    w_run = Window.partitionBy(*group_cols).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*group_cols)
    return bt.select(*group_cols, "bucket", "bt",
                     F.coalesce(F.sum("bt").over(w_run), F.lit(0)).alias("off"),
                     F.sum("bt").over(w_all).alias("n"))


def _running(vcb: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    w = (Window.partitionBy(*group_cols, "bucket").orderBy("value")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return vcb.withColumn("cum", F.sum("t").over(w))


def with_positions(vc: DataFrame, group_cols: Sequence[str], sizes: tuple[int, int] | None = None,
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Value counts with ``start``, ``avg_rank`` and the group's rows ``n``; other columns stay."""
    group_cols = list(group_cols)
    d_max, n_groups = sizes if sizes is not None else distinct_sizes(vc, group_cols)
    vcb = assign_buckets(vc, group_cols, d_max, rows_per_bucket)
    offsets = bucket_offsets(vcb, group_cols).select(*group_cols, "bucket", "off", "n")
    bound = n_groups * bucket_count(d_max, rows_per_bucket)
    pos = _running(vcb, group_cols).join(bounded_broadcast(offsets, bound), [*group_cols, "bucket"])
    pos = pos.withColumn("start", F.col("off") + F.col("cum") - F.col("t"))
    return pos.select(*vc.columns, "start", (F.col("start") + (F.col("t") + 1) / 2.0).alias("avg_rank"), "n")


def ranks_from_counts(vc: DataFrame, group_cols: Sequence[str], sizes: tuple[int, int] | None = None,
                      rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(group..., value, t, start, avg_rank, n)`` from value counts."""
    return with_positions(vc, group_cols, sizes, rows_per_bucket).select(*group_cols, "value", "t", "start", "avg_rank", "n")


def attach_ranks(rows: DataFrame, value: str, group_cols: Sequence[str], out: str,
                 rows_per_bucket: int = ROWS_PER_BUCKET, heavy: int = 1000, source: DataFrame | None = None,
                 held: list[DataFrame] | None = None) -> DataFrame:
    """``rows`` with ``out``: the average rank of ``value`` (never NULL) in its group.

    The ranks of at most ``FEW_VALUES`` values are broadcast and rows stay where they are. Of more, values that hold more than one in ``heavy`` rows of a group, at most ``heavy`` a group, are looked up from a broadcast
    table; their rows go past the join with the other ranks under keys of their own, so that join has no hot key,
    whatever share of the rows one value holds. ``source`` has the same values with a shorter plan, if ``rows`` has grown.
    With ``held`` the value counts are persisted and added to it; the caller frees them when the ranks are used.
    """
    g = list(group_cols)
    vc = value_counts((rows if source is None else source).select(*g, F.col(value).alias("value")), g)
    if held is not None:
        vc = vc.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(vc)
    of_group = vc.groupBy(*g).agg(F.count("*").alias("d"), F.sum("t").alias("n"), F.max("t").alias("top"))
    size = of_group.agg(F.max("d").alias("d"), F.count("*").alias("g"), F.max(F.col("top") / F.col("n")).alias("share")).first()
    sizes = (int(size["d"] or 0), int(size["g"] or 0))
    rt = ranks_from_counts(vc, g, sizes, rows_per_bucket).withColumnRenamed("value", value).withColumnRenamed("avg_rank", out)
    if sizes[0] * sizes[1] <= FEW_VALUES:
        return rows.join(bounded_broadcast(rt.select(*g, value, out), sizes[0] * sizes[1]), [*g, value])
    if (size["share"] or 0.0) * heavy <= 1:
        return rows.join(rt.select(*g, value, out), [*g, value])
    hot = rt.where(F.col("t") * heavy > F.col("n")).select(*g, value, F.col(out).alias("__hot"))
    met = rows.join(bounded_broadcast(hot, sizes[1] * heavy), [*g, value], "left")
    own = F.xxhash64(*[F.col(f"`{x}`") for x in rows.columns]).cast("double")
    met = met.withColumn("__met", F.col("__hot").isNotNull()).withColumn("__key", F.when(F.col("__met"), own).otherwise(F.col(value)))
    light = rt.where(F.col("t") * heavy <= F.col("n")).select(*g, F.col(value).alias("__key"), F.lit(False).alias("__met"), F.col(out).alias("__light"))
    return met.join(light, [*g, "__met", "__key"], "left").select(*rows.columns, F.coalesce("__hot", "__light").alias(out))


def rank_table(long_df: DataFrame, group_cols: Sequence[str] = ("column",), sizes: tuple[int, int] | None = None,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(group..., value, t, start, avg_rank, n)`` over the non-null values of each group."""
    return ranks_from_counts(value_counts(long_df, group_cols), group_cols, sizes, rows_per_bucket)


def quantiles_from_counts(vc: DataFrame, probs: Sequence[float], group_cols: Sequence[str] = ("column",),
                          sizes: tuple[int, int] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact linear-interpolated quantiles ``(group..., p, q)`` from value counts.

    With several buckets, only the buckets that hold a target position are sorted.
    """
    group_cols = list(group_cols)
    d_max, n_groups = sizes if sizes is not None else distinct_sizes(vc, group_cols)
    vcb = assign_buckets(vc, group_cols, d_max, rows_per_bucket)
    offsets = bucket_offsets(vcb, group_cols)
    bound = 2 * max(n_groups, 1) * len(probs)  # each (group, p) touches at most two buckets
    parr = F.array(*[F.lit(float(p)) for p in probs])
    targets = (offsets.select(*group_cols, "bucket", "bt", "off", "n", F.explode(parr).alias("p"))
               .withColumn("pos", F.col("p") * (F.col("n") - 1))
               .withColumn("lo", F.floor("pos")).withColumn("hi", F.ceil("pos"))
               .withColumn("frac", F.col("pos") - F.col("lo"))
               .where(((F.col("lo") >= F.col("off")) & (F.col("lo") < F.col("off") + F.col("bt")))
                      | ((F.col("hi") >= F.col("off")) & (F.col("hi") < F.col("off") + F.col("bt")))))
    if d_max > rows_per_bucket:
        needed = targets.select(*group_cols, "bucket").distinct()
        vcb = vcb.join(bounded_broadcast(needed, bound), [*group_cols, "bucket"], "left_semi")
    ranked = _running(vcb, group_cols)
    tsel = targets.select(*group_cols, "bucket", "off", "p", "lo", "hi", "frac")
    hit = (ranked.join(bounded_broadcast(tsel, bound), [*group_cols, "bucket"], "inner")
           .withColumn("start", F.col("off") + F.col("cum") - F.col("t"))
           .withColumn("h_lo", (F.col("lo") >= F.col("start")) & (F.col("lo") < F.col("start") + F.col("t")))
           .withColumn("h_hi", (F.col("hi") >= F.col("start")) & (F.col("hi") < F.col("start") + F.col("t")))
           .where(F.col("h_lo") | F.col("h_hi")))
    res = hit.groupBy(*group_cols, "p").agg(
        F.max(F.when(F.col("h_lo"), F.col("value"))).alias("v_lo"),
        F.max(F.when(F.col("h_hi"), F.col("value"))).alias("v_hi"),
        F.max("frac").alias("frac"))
    return res.select(*group_cols, "p",
                      (F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))).alias("q"))


def quantiles(long_df: DataFrame, probs: Sequence[float], group_cols: Sequence[str] = ("column",),
              sizes: tuple[int, int] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact quantiles ``(group..., p, q)`` of ``value`` per group (see module doc)."""
    return quantiles_from_counts(value_counts(long_df, group_cols), probs, group_cols, sizes, rows_per_bucket)


def pivot_quantiles(qs: DataFrame, probs: dict[str, float], group_cols: Sequence[str] = ("column",)) -> DataFrame:
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name) for name, p in probs.items()]
    return qs.groupBy(*group_cols).agg(*aggs)


def quantiles_wide(long_df: DataFrame, probs: dict[str, float], group_cols: Sequence[str] = ("column",),
                   **kw) -> DataFrame:
    """Quantiles pivoted to one column per name, e.g. ``{"q1": .25, "median": .5, "q3": .75}``."""
    return pivot_quantiles(quantiles(long_df, list(probs.values()), group_cols, **kw), probs, group_cols)
