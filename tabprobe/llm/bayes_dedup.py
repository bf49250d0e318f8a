"""Near-duplicate detection: MinHash bands, sequential Bayesian verification, exact verification.

1. Documents with equal shingle sets are one class; a class has one signature.
2. Classes that share a band of the signature are candidates. Their signatures are compared batch by batch; a pair is
   dropped as soon as the posterior probability of the wanted similarity, given the matches so far, is below
   ``miss``. What is left joins classes to clusters of possible links.
3. In a cluster all sets are compared exactly; components of exact links are the groups.

Buckets and clusters of more than ``BLOCK`` members are dealt out: a leader is compared with all members, those that
meet it are settled with it, and the others are compared block by block with everyone. No pairs are emitted: a block
gives each member's smallest partner by reachability, one row a member.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import salted_lookup, text_bytes, text_slices, written
from tabprobe.llm.components import connected_components
from tabprobe.llm.shingles import set_keys, shingle_sets, signatures

BANDS, BAND_ROWS = 24, 4
SIGNATURE, BATCH = 128, 16
BLOCK = 512
PAIRS_AT_ONCE = 1 << 19


# ---- posterior bounds -------------------------------------------------------------------------------------------

def least_matches(similarity: float, miss: float, size: int = SIGNATURE, batch: int = BATCH) -> list[int]:
    """For each batch end n the smallest number of matches with P(similarity or more | matches of n) >= ``miss``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum of n + 1 trials.
    """
    out = []
    for n in range(batch, size + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= miss:
                out.append(m)
                break
    return out


def surviving(sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, bounds: list[int], num: int, den: int) -> np.ndarray:
    """Which pairs (i, j) pass the size bound and every batch of the sequential comparison."""
    left = np.flatnonzero(den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(bounds):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches += (sig[i[left], part] == sig[j[left], part]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        left, matches = left[keep], matches[keep]
    return left


def local_labels(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``size`` nodes reaches over edges (i, j)."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside runs of the given sizes, as row indices."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(int(sizes.sum()))
    more = ends - at - 1
    i = np.repeat(at, more)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)
    return i, j


# ---- blocks -----------------------------------------------------------------------------------------------------

def in_blocks(entries: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """Entries (``group, c, settled``) dealt to pairs of blocks ``a, b``, with the ``side`` they are on.

    Blocks of entries that are not settled are compared with all blocks; settled ones not with each other.
    """
    sizes = entries.groupBy(group).agg(F.count_if(~F.col("settled")).alias("u"), F.count_if("settled").alias("s")).where("u > 0")
    sizes = sizes.select(group, F.ceil(F.col("u") / block).cast("int").alias("nu"), F.ceil(F.col("s") / block).cast("int").alias("ns"))
    e = salted_lookup(entries, sizes, [group], "inner", salts=16)
    spread = F.xxhash64("c", F.lit(17))
    e = e.withColumn("k", F.when(F.col("settled"), F.col("nu") + F.pmod(spread, F.greatest("ns", F.lit(1)))).otherwise(
        F.pmod(spread, F.col("nu"))).cast("int"))

    def upto(first: Column, last: Column) -> Column:
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    as_a = F.when(F.col("k") < F.col("nu"), F.transform(F.sequence("k", F.col("nu") + F.col("ns") - 1), lambda b: F.struct(
        F.col("k").alias("a"), b.alias("b"), F.lit(False).alias("side")))).otherwise(F.array().cast("array<struct<a:int,b:int,side:boolean>>"))
    as_b = F.transform(upto(F.lit(0), F.least(F.col("k"), F.col("nu")) - 1), lambda a: F.struct(
        a.alias("a"), F.col("k").alias("b"), F.lit(True).alias("side")))
    return e.withColumn("at", F.explode(F.concat(as_a, as_b))).select(*entries.columns, "at.a", "at.b", "at.side")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from sorted batches, of at least ``rows`` rows where there are more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(table.num_rows, bool)
        for k in keys:
            col = table.column(k).to_numpy()
            last &= col == col[-1]
        cut = int(np.argmax(last))  # the last run may go on
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def compare_signatures(blocks: DataFrame, group: str, bounds: list[int], num: int, den: int) -> DataFrame:
    """``a, b`` (longs): members linked to the smallest one that they reach over surviving pairs of a block pair.

    ``blocks`` has ``group, a, b, side, c, n, sig``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, [group, "a", "b"], 4096):
            g, a, b, side = (table.column(x).to_numpy() for x in (group, "a", "b", "side"))
            c, n = table.column("c").to_numpy(), table.column("n").to_numpy()
            raw = table.column("sig").combine_chunks()
            sig = np.frombuffer(b"".join(raw.to_pylist()), np.uint16).reshape(len(c), SIGNATURE)
            new = np.ones(len(c), bool)
            new[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(c)))
            at = 0
            while at < len(sizes):
                total = np.cumsum(sizes[at:] * (sizes[at:] - 1) // 2)
                take = max(1, int(np.searchsorted(total, PAIRS_AT_ONCE, side="right")))
                i, j = _pairs(sizes[at:at + take])
                i, j = i + first[at], j + first[at]
                if (cross := a[i] != b[i]).any():  # two blocks: pairs inside one are compared elsewhere
                    fit = ~cross | (side[i] != side[j])
                    i, j = i[fit], j[fit]
                left = surviving(sig, n, i, j, bounds, num, den)
                if len(left):
                    low, high = first[at], first[at] + int(sizes[at:at + take].sum())
                    label = local_labels(high - low, i[left] - low, j[left] - low) + low
                    moved = np.flatnonzero(label != np.arange(low, high)) + low
                    yield pa.RecordBatch.from_arrays([pa.array(c[moved]), pa.array(c[label[moved - low]])], names=["a", "b"])
                at += take

    keys = [group, "a", "b"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def exact_links(table: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with den * intersection >= num * union; sets are sorted uint64 arrays in binary ``set``."""
    sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = den * both >= num * (size[0] + size[1] - both)
        return (np.zeros(1, np.int64), np.ones(1, np.int64)) if ok else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(fresh) - 1
    uses = np.bincount(column)
    shared = np.flatnonzero(uses > 1)  # only these are in an intersection
    rank = np.full(len(uses), -1)
    rank[shared] = np.arange(len(shared))
    column, keep = rank[column], None
    keep = column >= 0
    column, owner = column[keep], owner[keep]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        both += x @ x.T  # counts of at most 4096, exact in single precision
    linked = den * both >= num * (size[:, None] + size[None, :] - both)
    return np.nonzero(np.triu(linked, 1))


def _settle(entries: DataFrame, leaders: DataFrame, group: str, meets: Callable[[pa.Table], np.ndarray], payload: str) -> DataFrame:
    """``entries`` with ``settled`` and the leader's id ``lead``: whether the group's leader meets the entry (itself: yes)."""
    schema = f"{group} long, c long, lead long, settled boolean"

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = pa.Table.from_batches([batch.slice(at, 512)])
                if part.num_rows:
                    cols = [part.column(x).combine_chunks() for x in (group, "c", "lead")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(meets(part))], names=[group, "c", "lead", "settled"])

    joined = salted_lookup(entries.select(group, "c", "n", payload),
                           leaders.select(group, F.col("c").alias("lead"), F.col("n").alias("lead_n"), F.col(payload).alias("lead_payload")),
                           [group], "inner")
    return joined.mapInArrow(test, schema)


# ---- the operator -----------------------------------------------------------------------------------------------

def document_classes(docs: DataFrame, width: int) -> DataFrame:
    """A row a document: ``doc_id, h`` (its key), set size ``n``, set keys ``ka, kb``, band keys, 16-bit signature."""
    schema = "doc_id long, h long, n long, ka long, kb long, bands array<long>, sig binary"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count in text_slices(batch):
                part = batch.slice(at, count)
                h, off = shingle_sets(*text_bytes(part.column("text")), width)
                full = signatures(h, off, SIGNATURE)
                ka, kb = set_keys(h, off)
                bands = np.zeros((count, BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(BAND_ROWS):
                        cols = full[:, k:BANDS * BAND_ROWS:BAND_ROWS].astype(np.uint64)
                        bands = (bands ^ cols) * np.uint64(0x9E3779B97F4A7C15)
                        bands ^= bands >> np.uint64(29)
                    bands += np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                flat = pa.array(np.ascontiguousarray(bands).view(np.int64).ravel())
                low = full.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(np.diff(off)), pa.array(ka), pa.array(kb),
                     pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * BANDS), flat),
                     pa.array([r.tobytes() for r in low], pa.binary())],
                    names=["doc_id", "h", "n", "ka", "kb", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, schema)


def candidate_clusters(classes: DataFrame, bounds: list[int], num: int, den: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``c, cluster`` of classes with a possible link, and ``c, degree`` (members of their large buckets)."""
    entries = classes.select("c", F.explode("bands").alias("bk"))
    counts = entries.groupBy("bk").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = written(salted_lookup(entries, counts, ["bk"], "inner", salts=8), "buckets")
    slim = classes.select("c", "n", "sig")
    # small buckets: those with the same members are compared once
    lists = shared.where(F.col("m") <= block).groupBy("bk").agg(F.array_sort(F.collect_list("c")).alias("l")).groupBy("l").agg(F.min("bk").alias("bk"))
    small = lists.select("bk", F.explode("l").alias("c"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("side"))
    edges = compare_signatures(small.join(slim, "c"), "bk", bounds, num, den)
    large = shared.where(F.col("m") > block)
    degree = large.groupBy("c").agg(F.sum("m").alias("degree"))
    if not large.isEmpty():
        full = written(large.join(slim, "c").join(degree, "c"), "large-buckets")
        best = full.groupBy("bk").agg(F.max(F.struct("degree", (-F.col("c")).alias("x"), "n", "sig")).alias("best"))
        leaders = best.select("bk", (-F.col("best.x")).alias("c"), "best.n", "best.sig")

        def meets(part: pa.Table) -> np.ndarray:
            k = part.num_rows
            both = part.column("sig").to_pylist() + part.column("lead_payload").to_pylist()
            sig = np.frombuffer(b"".join(both), np.uint16).reshape(2 * k, SIGNATURE)
            n = np.concatenate([part.column("n").to_numpy(), part.column("lead_n").to_numpy()])
            out = np.zeros(k, bool)
            out[surviving(sig, n, np.arange(k), np.arange(k) + k, bounds, num, den)] = True
            return out

        tested = written(_settle(full, leaders, "bk", meets, "sig"), "settled")
        blocks = in_blocks(tested.select("bk", "c", "settled"), "bk", block)
        edges = edges.unionByName(tested.where("settled AND c <> lead").select(F.col("c").alias("a"), F.col("lead").alias("b")))
        edges = edges.unionByName(compare_signatures(blocks.join(slim, "c"), "bk", bounds, num, den))
    return written(connected_components(edges).select(F.col("v").alias("c"), F.col("label").alias("cluster")), "clusters"), degree


def verified_components(docs: DataFrame, classes: DataFrame, clusters: DataFrame, degree: DataFrame, width: int, num: int,
                        den: int, block: int) -> DataFrame:
    """``c, comp``: components of exact links among classes that share a cluster."""
    wanted = clusters.join(classes.select("c", "n", F.col("rep.doc_id").alias("d"), F.col("rep.h").alias("rh")), "c")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("rh"))).select("c", "cluster", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count in text_slices(batch):
                part = batch.slice(at, count)
                h, off = shingle_sets(*text_bytes(part.column("text")), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("c"), part.column("cluster"), pa.array(np.diff(off)),
                     pa.array([h[x:y].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())],
                    names=["c", "cluster", "n", "set"])

    # rows of equal id and text give a class's set more than once: one is enough
    full = written(found.mapInArrow(sets, "c long, cluster long, n long, set binary").dropDuplicates(["c"]), "sets")
    sizes = full.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    few = sizes.where(F.col("m") <= block)
    small = full.select("c", "cluster").join(few.select("cluster"), "cluster").select(
        "cluster", "c", F.lit(False).alias("settled"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("side"))
    blocks, stars = small, None
    many = written(sizes.where(F.col("m") > block).select("cluster"), "large-clusters")
    if not many.isEmpty():
        large = salted_lookup(full, many, ["cluster"], "inner").join(degree, "c", "left").fillna({"degree": 0})
        best = large.groupBy("cluster").agg(F.max(F.struct("degree", (-F.col("c")).alias("x"))).alias("best"))
        named = best.select("cluster", (-F.col("best.x")).alias("c"))
        leaders = full.join(named, ["cluster", "c"])

        def meets(part: pa.Table) -> np.ndarray:
            out = []
            for x, y in zip(part.column("set").to_pylist(), part.column("lead_payload").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    out.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(den * both >= num * (len(x) + len(y) - both))
            return np.array(out, bool)

        tested = written(_settle(large, leaders, "cluster", meets, "set"), "settled-sets")
        stars = tested.where("settled AND c <> lead").select(F.col("c").alias("a"), F.col("lead").alias("b"))
        blocks = small.unionByName(in_blocks(tested.select("cluster", "c", "settled"), "cluster", block))

    def link(key: tuple, table: pa.Table) -> pa.Table:
        i, j = exact_links(table, num, den)
        if key[1].as_py() != key[2].as_py():
            side = table.column("side").to_numpy()
            i, j = i[side[i] != side[j]], j[side[i] != side[j]]
        label = local_labels(table.num_rows, i, j)
        moved = np.flatnonzero(label != np.arange(table.num_rows))
        c = table.column("c").to_numpy()
        return pa.table({"a": pa.array(c[moved], pa.int64()), "b": pa.array(c[label[moved]], pa.int64())})

    edges = blocks.join(full.select("c", "set"), "c").groupBy("cluster", "a", "b").applyInArrow(link, "a long, b long")
    edges = edges if stars is None else edges.unionByName(stars)
    return connected_components(edges).select(F.col("v").alias("c"), F.col("label").alias("comp"))


def near_dedup(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), miss: float = 1e-5, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, h, stays``: a row a document; one (``doc_id``, text hash ``h``) of a group stays.

    Two documents are linked where Jaccard similarity of their sets of ``width``-word shingles is at least
    ``similarity`` (a fraction); ``component_id`` is the smallest ``doc_id`` reached over links. A text of fewer words is one
    shingle; null and texts without words have none, are linked with nothing and are kept. A null id is never the smallest
    where there is another. Repeated ids keep a row each; other columns are ignored; an empty table gives an empty result.
    A linked pair is missed with a probability of at most (1 - s**4)**24 in the bands and about ``miss`` a batch.
    """
    num, den = similarity
    docs = docs.select("doc_id", "text")
    rows = written(document_classes(docs, width), "shingled")
    keys = ["ka", "kb", "n"]
    classes = rows.where("n > 0").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("low"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep"),
        F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    bounds = least_matches(num / den, miss)
    clusters, degree = candidate_clusters(classes, bounds, num, den, block)
    comps = written(verified_components(docs, classes, clusters, degree, width, num, den, block), "components")
    named = classes.select("c", *keys, "members", "low", "rep").join(comps, "c", "left")
    # the document that stays: the smallest id (a null id last), then the smallest text hash
    first = F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("rep.h").alias("h"))
    lows = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("low").alias("comp_low"), F.min(first).alias("comp_first"))
    named = named.join(lows, "comp", "left").withColumn("component", F.coalesce("comp_low", "low")).withColumn(
        "first", F.coalesce("comp_first", first))
    # classes of one document without a link need no lookup
    told = named.where("members > 1 OR comp IS NOT NULL").select(*keys, "component", "first", F.lit(True).alias("told"))
    out = salted_lookup(rows.select("doc_id", *keys, "h"), told, keys)
    linked = F.coalesce("told", F.lit(False)) & (F.col("n") > 0)
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    stays = ~linked | (F.col("doc_id").eqNullSafe(F.col("first.low")) & (F.col("h") == F.col("first.h")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "h", stays.alias("stays"))


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies (see ``near_dedup``); all rows without words stay."""
    found = near_dedup(docs, **options)
    none = F.lit(-(2**63))
    chosen = found.where("stays").select(F.coalesce("doc_id", none).alias("__d"), F.col("h").alias("__h"),
                                         (F.col("n_shingles") == 0).alias("__wordless")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("__d"),
                        F.xxhash64("text").alias("__h"))
    # equal rows meet map-side, so that a hot group is one row a task; rows without words are told apart and all stay
    own = F.when(F.col("__wordless"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    kept = keyed.join(chosen, ["__d", "__h"]).withColumn("__u", own).dropDuplicates(["__d", "__h", "__u"])
    return kept.select("row.*")
