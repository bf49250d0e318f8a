"""Sharding by balanced label propagation.

Documents are linked through hubs (here: equal texts); a hub is a vertex, so a group of n documents has n links and
not n * n. Each round is some Spark joins and aggregations over slim rows: hubs count their members by shard, members
move to their hub's home shards, and quotas give each shard exactly its number of rows: settled documents first,
then arrivals, then documents without links; who finds no room goes where there is some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabprobe.llm.common import salted_lookup, written

#: A group is numbered in sub-buckets of about so many rows.
ROWS_PER_BUCKET = 500_000


def _ranked(df: DataFrame, group: str, major: str, out: str, n_rows: int) -> DataFrame:
    """``out``: rank from 0 in each group, by ``major`` first; sub-buckets keep a group from being one task."""
    buckets = max(32, n_rows // ROWS_PER_BUCKET)
    b = df.withColumn("__b", F.col(major) * buckets + F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(buckets)).cast("int"))
    sizes = b.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.sum("__n").over(W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(group, "__b", F.coalesce(ahead, F.lit(0)).alias("__o"))
    inside = F.row_number().over(W.partitionBy(group, "__b").orderBy("uid"))
    return (b.withColumn("__r", inside).join(offsets, [group, "__b"])
            .withColumn(out, (F.col("__o") + F.col("__r") - 1).cast("long")).drop("__b", "__o", "__r"))


def _homes(counts: DataFrame, quota: int) -> DataFrame:
    """``hub, homes``: the shards where most of a hub's rows are, as many as its size needs, with room left there."""
    sized = counts.withColumn("size", F.sum("n").over(W.partitionBy("hub"))).withColumn(
        "r", F.row_number().over(W.partitionBy("hub").orderBy(F.desc("n"), F.xxhash64("hub", "shard"))))
    home = sized.where(F.col("r") <= F.ceil(F.col("size") / F.lit(max(1, quota))))
    return home.groupBy("hub").agg(F.array_sort(F.collect_list(
        F.struct("shard", F.greatest(F.lit(0), F.lit(quota) - F.col("n")).alias("room")))).alias("homes"))


def cut_links(state: DataFrame) -> DataFrame:
    """``links, cut``: links of members to their hub's most common shard, and those that leave it. One row."""
    counts = state.where("hub IS NOT NULL").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    hubs = counts.groupBy("hub").agg(F.sum("n").alias("links"), F.max("n").alias("most"))
    return hubs.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
                    F.coalesce(F.sum(F.col("links") - F.col("most")), F.lit(0)).alias("cut"))


def propagate(state: DataFrame, n_rows: int, shards: int, rounds: int) -> DataFrame:
    """``uid, hub, shard`` after ``rounds`` moves; every shard has its quota of rows after each (at most one apart)."""
    low, extra = divmod(n_rows, shards)
    quotas = state.sparkSession.range(shards).select(
        F.col("id").cast("int").alias("want"), (F.lit(low) + (F.col("id") < extra).cast("long")).alias("quota"))
    for _ in range(rounds):
        counts = state.where("hub IS NOT NULL").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        linked = salted_lookup(state.where("hub IS NOT NULL"), _homes(counts, low), ["hub"], "inner")
        total = F.aggregate("homes", F.lit(0).cast("long"), lambda a, h: a + h["room"])
        # a home by the room left in each, drawn by a hash of the row
        draw = F.pmod(F.xxhash64("uid", F.col("shard"), F.lit(11)), F.greatest(F.col("total"), F.lit(1)))
        chosen = F.aggregate("homes", F.struct(F.lit(0).cast("long").alias("a"), F.lit(-1).alias("s")), lambda acc, h: F.struct(
            (acc["a"] + h["room"]).alias("a"),
            F.when((acc["s"] < 0) & (F.col("draw") < acc["a"] + h["room"]), h["shard"]).otherwise(acc["s"]).alias("s")))["s"]
        at_home = F.exists("homes", lambda h: h["shard"] == F.col("shard"))
        linked = (linked.withColumn("total", total).withColumn("draw", draw).withColumn("pick", chosen)
                  .withColumn("want", F.when(at_home | (F.col("pick") < 0), F.col("shard")).otherwise(F.col("pick")))
                  .withColumn("class", F.when(at_home, 0).otherwise(1)))
        free = state.where("hub IS NULL").withColumn("want", F.col("shard")).withColumn("class", F.lit(2))
        cols = ["uid", "hub", "want", "class"]
        ranked = _ranked(linked.select(cols).unionByName(free.select(cols)), "want", "class", "r", n_rows).join(
            F.broadcast(quotas), "want")  # a row a shard
        ranked = written(ranked.withColumn("stays", F.col("r") < F.col("quota")), "lp-ranked")
        held = ranked.groupBy("want").agg(F.sum(F.col("stays").cast("long")).alias("held"))
        room = quotas.join(held, "want", "left").withColumn("room", F.col("quota") - F.coalesce("held", F.lit(0)))
        ends = room.withColumn("end", F.sum("room").over(W.orderBy("want"))).where("room > 0").select(  # a row a shard
            F.col("want").alias("to"), (F.col("end") - F.col("room")).alias("begin"), "end")
        over = _ranked(ranked.where("NOT stays").select("uid", "hub", F.lit(0).alias("all"), F.lit(0).alias("class")),
                       "all", "class", "k", n_rows)
        moved = over.join(F.broadcast(ends), (F.col("k") >= F.col("begin")) & (F.col("k") < F.col("end")))
        state = written(ranked.where("stays").select("uid", "hub", F.col("want").alias("shard")).unionByName(
            moved.select("uid", "hub", F.col("to").alias("shard"))), "lp-state")
    return state


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 4) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, linked``: all documents in shards 0 to ``shards`` - 1.

    Law ``rows``: shard counts are at most one apart. Links join equal texts (a null text equals an empty one). Groups
    larger than a shard fill several. ``slot`` counts a shard's rows from 0. Needs ``doc_id`` and ``text``; null and
    repeated ids are rows of their own; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest")), "lp-rows")
    n = rows.count()
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("hub")).where("n > 1")
    linked = salted_lookup(rows.select("uid", "digest"), groups.select("digest", "hub"), ["digest"])
    start = _ranked(linked.select("uid", "hub", F.lit(0).alias("all"), F.lit(0).alias("class")), "all", "class", "r", n)
    start = written(start.select("uid", "hub", (F.col("r") % shards).cast("int").alias("shard")), "lp-state")
    state = propagate(start, n, shards, rounds)
    done = _ranked(state.withColumn("class", F.lit(0)), "shard", "class", "slot", n)
    return rows.join(done, "uid").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("hub").isNotNull().alias("linked"))
