"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

1. A text's fingerprint has bit i where over half of the XXH64 hashes of its word shingles have it. Equal fingerprints
   are one class.
2. Each bit position gets a vector of GF(2)^(radius + 1) other than zero. For each such vector v there is a table whose
   mask keeps the positions with an odd inner product with v. The at most ``radius`` positions in which two near
   fingerprints differ span less than the whole space, so some v is orthogonal to all of them: its mask hides them and
   the two collide. With radius 4 there are 31 tables of about half the bits each.
3. In a bucket, components of fingerprints within the radius are found by walking from one to all not yet reached; only
   a star for each component is given on. A bucket of more than ``HOT`` fingerprints is passed on instead, and covered
   again over the bits that its mask leaves free, which keeps the guarantee; free bits halve each time, so that after
   three times at most 2^8 fingerprints can share a bucket. No bucket is cut and no pair is lost.

Nulls and texts without words have fingerprint zero and are linked like any other; a null ``doc_id`` is never the
smallest; repeated rows stay rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import LOWER_TABLE, salted_lookup, text_bytes, text_slices, words_of, written
from tabprobe.llm.components import connected_components

BITS = 64
HOT = 4096
#: Buckets with at most so many free bits are settled, whatever ``HOT`` is.
LAST = 8
#: Shingles whose bits are counted at once, and fingerprint comparisons at once.
AT_ONCE = 1 << 17
PAIRS_AT_ONCE = 1 << 20


# ---- fingerprints -----------------------------------------------------------------------------------------------

def joined_words(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words, each followed by one space, with their starts and ends there and n + 1 word offsets of the rows."""
    starts, stops, first = words_of(data, off)
    lens = stops - starts
    ends = np.cumsum(lens + 1) - 1
    begins = ends - lens
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    at = np.repeat(starts - begins, lens) + np.flatnonzero(_spans(begins, ends, len(out)))
    out[at - np.repeat(starts - begins, lens)] = data[at]
    return out.tobytes(), begins, ends, first


def _spans(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans, which don't meet."""
    edge = np.zeros(n + 1, np.int8)
    edge[begins] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1]).astype(bool)


def fingerprints_of(data: np.ndarray, off: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    """A uint64 fingerprint for each text."""
    text, begins, ends, first = joined_words(LOWER_TABLE[data], off)
    n_words = np.diff(first)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(counts)])
    ones = np.zeros((len(counts), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, int(edge[-1]), AT_ONCE):
        at = np.arange(low, min(low + AT_ONCE, int(edge[-1])))
        row = np.searchsorted(edge, at, side="right") - 1
        word = first[:-1][row] + at - edge[:-1][row]
        last = np.minimum(word + width, first[1:][row]) - 1
        h = np.fromiter((digest(text[a:b], seed) for a, b in zip(begins[word].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(at))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows, start = np.unique(row, return_index=True)
        ones[rows] += np.add.reduceat(bits, start, axis=0, dtype=np.int64)
    bits = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row's whole text as a signed long."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n in text_slices(batch):
                part = batch.slice(i, n)
                fp = fingerprints_of(*text_bytes(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(scan, f"doc_id {kind}, fp long")


# ---- covering tables --------------------------------------------------------------------------------------------

def covering_masks(fixed: int, radius: int) -> np.ndarray:
    """Masks of 2^(radius + 1) - 1 tables that fix ``fixed`` and cover the other bits.

    Vectors are dealt to the free positions in turn, so that each is used almost equally often.
    """
    size = (1 << (radius + 1)) - 1
    free = [i for i in range(BITS) if not fixed >> i & 1]
    return np.array([fixed | sum(1 << i for k, i in enumerate(free) if bin((k % size + 1) & v).count("1") % 2)
                     for v in range(1, size + 1)], np.uint64)


def in_tables(prints: DataFrame, radius: int) -> DataFrame:
    """``fp, mask, key``: each fingerprint (``fp``, fixed bits ``mask``) in all tables that cover its free bits."""
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            fixed = batch.column("mask").to_numpy().view(np.uint64)
            kinds, kind = np.unique(fixed, return_inverse=True)
            for one in kinds.tolist():
                if one not in known:
                    known[one] = covering_masks(one, radius)
            if len(fp):
                mask = np.stack([known[one] for one in kinds.tolist()])[kind]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.reshape(-1).view(np.int64)) for x in (np.broadcast_to(fp[:, None], mask.shape), mask, mask & fp[:, None])],
                    ["fp", "mask", "key"])

    return prints.mapInArrow(cover, "fp long, mask long, key long")


def stars(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a bucket the one its component was first reached from."""
    root = np.arange(len(fp))
    left = np.arange(len(fp))
    while len(left):
        begin, left = left[0], left[1:]
        reached = np.array([begin])
        while len(reached) and len(left):  # each fingerprint is once compared with all that are not yet reached
            step = max(1, PAIRS_AT_ONCE // len(left))
            near = np.zeros(len(left), bool)
            for i in range(0, len(reached), step):
                near |= (np.bitwise_count(fp[reached[i:i + step], None] ^ fp[left]) <= radius).any(axis=0)
            reached, left = left[near], left[~near]
            root[reached] = begin
    return root


def _runs(mask: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where runs of equal (mask, key) begin, and the end."""
    new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
    return np.concatenate([[0], new, [len(mask)]])


def bucket_links(tables: DataFrame, radius: int, hot: int) -> DataFrame:
    """``a, b, mask``: links inside buckets as stars (``mask`` null), and fingerprints ``a`` of hot buckets with theirs.

    Rows come sorted by bucket; at most ``hot`` of a bucket are held, more of them are passed on as they come.
    """
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None) -> pa.RecordBatch:
            held = pa.nulls(len(a), pa.int64()) if mask is None else pa.array(mask.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), held], ["a", "b", "mask"])

        def links(fp: np.ndarray, mask: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = _runs(mask, key)
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            found = [(fp[near], fp[near + 1])]
            large = (size > hot) & splits(mask[edge[:-1]])
            for k in np.flatnonzero((size > 2) & ~large):
                mine = np.unique(fp[edge[k]:edge[k + 1]])
                root = stars(mine, radius)
                found.append((mine, mine[root]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield out(a[a != b], b[a != b], None)
            for k in np.flatnonzero(large):
                part = slice(edge[k], edge[k + 1])
                yield out(fp[part], fp[part], mask[part])

        def splits(mask: np.ndarray) -> np.ndarray:
            return np.bitwise_count(mask) < BITS - LAST

        none = np.zeros(0, np.uint64)
        fp, mask, key, passing = none, none, none, False
        for batch in batches:
            new = [batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "mask", "key")]
            if len(new[0]) == 0:
                continue
            if passing:  # a hot bucket that has been passed on goes on
                same = (new[1] == mask[-1]) & (new[2] == key[-1])
                n = len(same) if same.all() else int(np.argmin(same))
                yield out(new[0][:n], new[0][:n], new[1][:n])
                if n == len(same):
                    continue
                fp, mask, key, passing, new = none, none, none, False, [x[n:] for x in new]
            fp, mask, key = (np.concatenate([x, y]) for x, y in zip((fp, mask, key), new, strict=True))
            cut = int(_runs(mask, key)[-2])  # the last run may go on
            if cut:
                yield from links(fp[:cut], mask[:cut], key[:cut])
                fp, mask, key = fp[cut:], mask[cut:], key[cut:]
            if len(fp) > hot and splits(mask[-1]):
                yield out(fp, fp, mask)
                passing = True
        if len(fp) and not passing:
            yield from links(fp, mask, key)

    dealt = tables.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(solve, "a long, b long, mask long")


def near_links(prints: DataFrame, radius: int = 4, hot: int = HOT) -> DataFrame:
    """``a, b``: links that join all distinct fingerprints (``fp``) to their components within ``radius`` bits."""
    found, left = None, prints.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        got = written(bucket_links(in_tables(left, radius), radius, hot), "covering")
        links = got.where("mask IS NULL").select("a", "b")
        found = links if found is None else found.unionByName(links)
        left = got.where("mask IS NOT NULL").select(F.col("a").alias("fp"), "mask").distinct()
        if left.isEmpty():
            return found


def covering_dedup(docs: DataFrame, radius: int = 4, width: int = 4, hot: int = HOT) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id, kept`` for each row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest ``doc_id``
    reachable (null only where all of a component are null).
    """
    prints = written(fingerprints(docs, width), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    label = connected_components(near_links(classes, radius, hot))
    tied = classes.join(label.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    low = tied.groupBy("label").agg(F.min("low").alias("component_id"))
    by_class = salted_lookup(tied.select("fp", "label"), low, ["label"], "inner", salts=8).select("fp", "component_id")
    return salted_lookup(prints, by_class, ["fp"], "inner", salts=8).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
