"""Exact dedup by content-defined chunk recipes.

Every text is cut where a hash of the last ``WINDOW`` bytes meets a mask, so equal texts get equal cuts. A
document becomes its recipe: the ordered list of chunk identifiers. Long texts are read once, where they lie;
only recipes (some bytes a chunk) are shuffled.

A chunk's weak hash (64 bits) is made a verified identifier with the chunk's SHA-256: where a weak hash stands
for several digests, the identifier carries the digest's rank among them, so different chunks never share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabprobe.llm.common import (
    _BASE,
    _BASE_INV,
    _BYTE_HASH,
    LOWER_TABLE,
    _powers,
    mix64,
    salted_lookup,
    span_hashes,
    text_bytes,
    text_slices,
    written,
)

WINDOW = 16
RECIPE = "uid long, doc_id long, n_bytes long, text_sha256 string, weak array<long>, strong array<binary>"


def cut_points(data: np.ndarray, off: np.ndarray, avg_bytes: int, min_bytes: int, max_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts over all rows (a row's first byte starts one) and n + 1 chunk offsets of the rows."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_HASH[data] * _powers(_BASE, len(data)), out=run[1:])
        n = max(0, len(data) - WINDOW + 1)
        rolling = mix64((run[WINDOW:] - run[:-WINDOW]) * _powers(_BASE_INV, n)) if n else np.zeros(0, np.uint64)
    hits = np.flatnonzero((rolling & np.uint64(avg_bytes - 1)) == 0) + WINDOW  # a cut after this many bytes
    starts, firsts = [], [0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b > a:
            last = a
            starts.append(a)
            for h in [*hits[np.searchsorted(hits, a + min_bytes):np.searchsorted(hits, b)].tolist(), b]:
                while h - last > max_bytes:  # no cut for long: cut at the largest size
                    last += max_bytes
                    starts.append(last)
                if h < b and h - last >= min_bytes:
                    last = h
                    starts.append(h)
        firsts.append(len(starts))
    return np.array(starts, np.int64), np.array(firsts, np.int64)


def chunk_recipes(docs: DataFrame, avg_bytes: int = 2048, min_bytes: int = 256, max_bytes: int = 16384,
                  hash_bits: int = 64) -> DataFrame:
    """One row a document: row id, size, SHA-256 of the normalised text, weak and strong hashes of its chunks in order.

    Texts are lower-cased in A-Z; a null text counts as empty and has an empty recipe. ``avg_bytes`` is a
    power of two, ``min_bytes`` is at least ``WINDOW``. ``hash_bits`` below 64 is for tests of colliding weak hashes.
    """
    shift = np.uint64(64 - hash_bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n in text_slices(batch):
                part = batch.slice(i, n)
                raw, off = text_bytes(part.column("text"))
                data = LOWER_TABLE[raw]
                starts, firsts = cut_points(data, off, avg_bytes, min_bytes, max_bytes)
                stops = np.concatenate([starts[1:], off[-1:]]) if len(starts) else starts
                weak = (span_hashes(data, starts, stops) >> shift).view(np.int64)
                whole = memoryview(data.tobytes())
                strong = [hashlib.sha256(whole[a:b]).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                sha = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                at = pa.array(firsts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id"), pa.array(np.diff(off)), pa.array(sha),
                     pa.ListArray.from_arrays(at, pa.array(weak)), pa.ListArray.from_arrays(at, pa.array(strong, pa.binary()))],
                    names=["uid", "doc_id", "n_bytes", "text_sha256", "weak", "strong"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, RECIPE)


def verified_recipes(recipes: DataFrame) -> DataFrame:
    """Recipes whose ``ids`` are verified identifiers: (weak hash, rank of the digest among those of this weak hash).

    Only weak hashes that stand for several digests have ranks other than 0; just their digests are looked up.
    """
    chunks = recipes.select("uid", F.posexplode(F.arrays_zip("weak", "strong")).alias("pos", "c")).select(
        "uid", "pos", "c.weak", "c.strong")
    distinct = chunks.groupBy("weak", "strong").agg(F.count(F.lit(1)).alias("uses"))
    several = distinct.groupBy("weak").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("weak")
    ranks = (distinct.join(several, "weak", "left_semi")
             .select("weak", "strong", (F.row_number().over(W.partitionBy("weak").orderBy("strong")) - 1).alias("rank")))
    ranks = written(ranks, "chunk-ranks")
    if ranks.isEmpty():
        ids = F.transform("weak", lambda w: F.struct(w.alias("weak"), F.lit(0).alias("rank")))
        return recipes.select("uid", "doc_id", "n_bytes", "text_sha256", ids.alias("ids"))
    known = salted_lookup(chunks, ranks, ["weak", "strong"]).fillna({"rank": 0})
    lists = known.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "weak", "rank"))).alias("l"))
    ids = F.transform(F.coalesce("l", F.array().cast("array<struct<pos:int,weak:bigint,rank:int>>")),
                      lambda x: F.struct(x["weak"].alias("weak"), x["rank"].alias("rank")))
    return recipes.join(lists, "uid", "left").select("uid", "doc_id", "n_bytes", "text_sha256", ids.alias("ids"))


def exact_dedup(docs: DataFrame, **cutting) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``: a row a document, equal texts in one group.

    Needs columns ``doc_id`` (any value, nulls and repeats too) and ``text``; others are ignored. Texts are equal
    when identical after lower-casing A-Z; null counts as empty. Of a group the row with the largest ``doc_id``
    stays (null is smallest); of several such rows, one. An empty table gives an empty result.
    """
    recipes = written(chunk_recipes(docs, **cutting), "recipes")
    rows = verified_recipes(recipes).withColumn("key", F.xxhash64("ids", "n_bytes"))
    # the hash only deals rows out; groups are equal identifier lists
    groups = rows.groupBy("key", "n_bytes", "ids").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("doc_id", (-F.col("uid")).alias("u"))).alias("best")).where("group_size > 1")
    found = salted_lookup(rows, groups, ["key", "n_bytes", "ids"])  # documents of their own find no group
    alone = F.col("best").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == -F.col("best.u"))).alias("kept"), "text_sha256", F.size("ids").cast("long").alias("n_chunks"))
