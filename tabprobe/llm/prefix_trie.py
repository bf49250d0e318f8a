"""Prefix trie of conversations, rolled up by bands of depth.

1. Turns are numbered in their conversation from one sort over all rows by ranges of (conversation, turn), so that a very
   long conversation is dealt over many tasks. A conversation's path is rebuilt from its own turns and the first turns of
   its base conversation.
2. A node is known by its depth and two 64-bit sums (xor) of hashes of (depth, turn) along the path. Sums of chunks of
   1,024 turns are added up apart, so paths aren't walked.
3. Totals over subtrees: a node gives its value to itself and its ancestors in its band of ``BAND`` depths, at most
   ``BAND`` rows a node. The tops of bands, with the totals of their bands as values, are a tree of a depth ``BAND``
   times smaller, which is rolled up in the same way. A top's finished total then goes once to its ancestors in the
   band above. So rounds grow with the logarithm of the depth, and no round explodes a node to more than a band.
4. The ids of those that end at a node are joined to pieces of at most ``PIECE`` ids; a task hashes a node's pieces as
   they come and never holds them together.

Rows without ``conv_id`` belong to no conversation and are left out; null roles and texts are empty; a null turn comes
first; equal turns are ordered by role, then text; repeated rows are turns of their own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabprobe.llm.common import salted_lookup, written

BAND, PIECE, CHUNK = 8, 512, 1024
#: Conversations of one base, and the most turns taken from it.
FAMILY, TAKEN = 20, 3
KEY = ["depth", "k1", "k2"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# ---- paths ------------------------------------------------------------------------------------------------------

def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, pid, at, t1, t2, words`` of each turn, and ``conv, pid, first, before, total`` of each run of turns.

    A turn's place in its conversation, from 1, is ``at - first + before + 1``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    turns = written(placed.select(
        "conv", F.shiftright("at", 33).alias("pid"), "at", F.xxhash64("role", "text").alias("t1"),
        F.xxhash64(F.lit("second"), "text", "role").alias("t2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")), "turns")
    runs = turns.groupBy("conv", "pid").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    mine = W.partitionBy("conv")
    earlier = mine.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("conv", "pid", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(mine).alias("total"))
    return turns, written(runs, "runs")


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """``conv, depth, k1, k2, p1, p2, words, last``: every node on each rebuilt conversation's path, the root too.

    ``k1, k2`` tell the sequence up to ``depth``, ``p1, p2`` the one before; ``last`` marks the path's end.
    """
    turns, runs = numbered_turns(conversations)
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(TAKEN + 1)).cast("long")
    base = F.col("conv") - F.col("conv") % F.lit(FAMILY)
    convs = runs.groupBy("conv").agg(F.max("total").alias("total")).select("conv", "total", taken.alias("h"), base.alias("base"))
    sizes = convs.where("conv = base").select("base", F.least("total", F.lit(TAKEN)).alias("there"))
    convs = written(convs.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).drop("there"), "convs")
    placed = turns.join(runs.drop("total").join(convs, "conv"), ["conv", "pid"]).withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1)
    slim = ["conv", "depth", "t1", "t2", "words", "last"]
    own = placed.where("place > h").withColumn("depth", F.expr("k + place - h")).withColumn("last", F.expr("place = total")).select(slim)
    lent = placed.where(f"conv = base AND place <= {TAKEN}").select("base", F.col("place").alias("depth"), "t1", "t2", "words")
    lent = convs.join(lent, "base").where("depth <= h").withColumn("last", F.expr("depth = k AND total <= h")).select(slim)
    steps = own.unionByName(lent)

    steps = steps.select("conv", "depth", F.expr(f"depth div {CHUNK}").alias("chunk"), F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("s1"),
                         F.xxhash64(F.lit(2), "depth", "t2", "t1").alias("s2"), "words", "last")
    sums = steps.groupBy("conv", "chunk").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"))
    earlier = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv", "chunk", *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(o) for s, o in (("s1", "o1"), ("s2", "o2"))])
    upto = W.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    keyed = (steps.withColumn("c1", F.bit_xor("s1").over(upto)).withColumn("c2", F.bit_xor("s2").over(upto)).join(sums, ["conv", "chunk"])
             .select("conv", "depth", F.col("c1").bitwiseXOR(F.col("o1")).alias("k1"), F.col("c2").bitwiseXOR(F.col("o2")).alias("k2"), "s1", "s2", "words", "last")
             .select("conv", *KEY, F.col("k1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("s2")).alias("p2"), "words", "last"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", *[zero.alias(c) for c in (*KEY, "p1", "p2", "words")], F.expr("k = 0 AND total <= h").alias("last"))
    return written(keyed.select(roots.columns).unionByName(roots), "paths")


# ---- totals over subtrees ---------------------------------------------------------------------------------------

def _in_bands(paths: DataFrame, step: int, band: int) -> DataFrame:
    """``conv, band, keys``: the nodes of each path at depths that ``step`` divides, at most ``band`` a row."""
    return (paths.where(F.col("depth") % step == 0).groupBy("conv", F.expr(f"depth div {step * band}").alias("band"))
            .agg(F.collect_list(F.struct(*KEY)).alias("keys")))


def _to_ancestors(values: DataFrame, bands: DataFrame, at: Column, names: list[str]) -> DataFrame:
    """Each node's values summed at the nodes of its path in the band ``at`` that are not below it."""
    given = values.select("*", at.alias("band")).join(bands, ["conv", "band"])
    keys = F.filter("keys", lambda x: x["depth"] <= F.col("depth"))
    given = given.select(F.explode(keys).alias("to"), *names)
    return given.select("to.*", *names).groupBy(KEY).agg(*[F.sum(c).alias(c) for c in names])


def subtree_totals(nodes: DataFrame, paths: DataFrame, names: list[str], deepest: int, step: int = 1, band: int = BAND) -> DataFrame:
    """``depth, k1, k2`` and the ``names`` of ``nodes`` summed over each node's subtree.

    ``nodes`` has ``conv`` (any member), all at depths that ``step`` divides.
    """
    bands = _in_bands(paths, step, band)
    here = F.expr(f"depth div {step * band}")
    if deepest < step * band:
        return _to_ancestors(nodes, bands, here, names)
    bands = written(bands, "bands")
    inside = written(_to_ancestors(nodes, bands, here, names), "inside")
    tops = written(nodes.select("conv", *KEY).where(F.col("depth") % (step * band) == 0).join(inside, KEY), "tops")
    done = subtree_totals(tops, paths, names, deepest, step * band, band)
    done = tops.select("conv", *KEY).join(done, KEY).where("depth > 0")
    below = _to_ancestors(done, bands, F.expr(f"depth div {step * band} - 1"), names)
    return inside.unionByName(below).groupBy(KEY).agg(*[F.sum(c).alias(c) for c in names])


# ---- members that end at a node ---------------------------------------------------------------------------------

def end_digests(paths: DataFrame, piece: int = PIECE) -> DataFrame:
    """``depth, k1, k2, sha``: SHA-256 of the ascending, comma-joined ids of the paths that end at a node."""
    pieces = paths.where("last").groupBy(*KEY, F.expr(f"conv div {piece}").alias("piece")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = [*KEY, "sha"]
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names)

    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    return dealt.select(*KEY, "ids").mapInArrow(digest, "depth long, k1 long, k2 long, sha string")


def prefix_trie(conversations: DataFrame, band: int = BAND, piece: int = PIECE) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``n_ends``,
    ``saved_tokens`` and ``ends_sha256``.
    """
    paths = rebuilt_paths(conversations)
    nodes = paths.groupBy(KEY).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.first("words").alias("words"), F.count_if("last").alias("n_ends"))
    nodes = written(nodes, "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    above = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(above, F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    values = nodes.select("conv", *KEY, F.expr("CAST(n_children = 0 AS long)").alias("n_leaves"), F.expr("(n_convs - 1) * words").alias("saved_tokens"))
    totals = subtree_totals(values, paths, ["n_leaves", "saved_tokens"], deepest, band=band)
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                                    F.col("conv").alias("parent_conv_id"))
    out = salted_lookup(nodes, parents, ["depth", "p1", "p2"], "left", salts=8).join(totals, KEY).join(end_digests(paths, piece), KEY, "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "n_ends", "saved_tokens",
                      F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
