"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a node for every context of 0 to ``depth`` bytes before it. A node
estimates by Krichevsky-Trofimov from its counts; the weighted probability of a node is half its own estimate and half
the product of its children's, so all depths are mixed by how well they told the training bytes. A text's score is its
log10 probability, an end byte included; contexts do not cross documents.

Counts of (context, byte) grams are gathered by a shuffle. Contexts that share their two nearest bytes form a subtree of
their own, worked out by one task each; only the top of the tree (contexts of at most one byte: 65,536 nodes at most)
is one small table. Documents are put into block files in the shared folder; a block asks for the values of its distinct
grams and words and gets them by a shuffle, so no model is held whole anywhere and texts are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import LOWER_TABLE, shared_path, span_hashes, text_bytes, text_slices, words_of, written
from tabprobe.llm.files import open_read, put_file

#: Kinds of keys that blocks ask for.
GRAM, TOKEN = 1, 2
#: The key of the end token; no word has it but by chance of 2 ** -64.
END_KEY = np.uint64(0x454E44)
#: Grams are dealt to so many subtree tasks by their two nearest context bytes.
SUBTREES = 512
ASKED = "kind int, block long, key long, uses long"


# ---- grams and words of texts -----------------------------------------------------------------------------------

def byte_grams(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A gram for each byte and each row's end: the byte lowest, its nearest context byte next, up to ``depth`` of them.

    Zero stands for the end and for what is before a row's beginning. Also gives the n + 1 offsets of the rows' grams.
    """
    seq = np.insert(data, off[1:], 0).astype(np.uint64)
    at = off + np.arange(len(off))
    inside = np.arange(len(seq)) - np.repeat(at[:-1], np.diff(at))
    out = seq.copy()
    for k in range(1, depth + 1):
        before = np.zeros(len(seq), np.uint64)
        before[k:] = seq[:-k]
        before[inside < k] = 0
        out |= before << np.uint64(8 * k)
    return out, at


def row_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of each row, then its end token, and the n + 1 offsets of the rows."""
    starts, stops, first = words_of(data, off)
    return np.insert(span_hashes(data, starts, stops), first[1:], END_KEY), first + np.arange(len(first))


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their weights."""
    order = np.argsort(keys)
    k, w = keys[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(w, first) if len(k) else np.zeros(0, np.int64)


def _block_file(folder: str, block: int) -> str:
    return f"{folder}/{block}.arrow"


def block_keys(docs: DataFrame, folder: str, depth: int, block_bytes: int) -> DataFrame:
    """``kind, block, key, uses``: each block's distinct grams and words with their uses in training documents.

    Texts (``doc_id, held_out, text``) go to a file a block. A block is named by its task's partition and its place there, so
    a task that runs again writes the same files.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []
        parts: dict[int, list] = {GRAM: [], TOKEN: []}

        def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
            return _counted(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

        def flush() -> Iterator[pa.RecordBatch]:
            block = part * 1_000_000 + seq
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for piece in held:
                    out.write_batch(piece)
            put_file(_block_file(folder, block), sink.getvalue())
            held.clear()
            for kind, found in parts.items():
                keys, uses = merged(found)
                found.clear()
                for a in range(0, len(keys), 100_000):
                    m = min(len(keys), a + 100_000) - a
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, block)),
                                                      pa.array(keys[a:a + m].view(np.int64)), pa.array(uses[a:a + m])], names=names)

        names = ["kind", "block", "key", "uses"]
        for batch in batches:
            for i, n in text_slices(batch, max_bytes=2 << 20):
                piece = batch.slice(i, n)
                raw, off = text_bytes(piece.column("text"))
                data = LOWER_TABLE[raw]
                train = (~piece.column("held_out").to_numpy(zero_copy_only=False)).astype(np.int64)
                for kind, (keys, at) in ((GRAM, byte_grams(data, off, depth)), (TOKEN, row_tokens(data, off))):
                    parts[kind].append(_counted(keys, np.repeat(train, np.diff(at))))
                    if len(parts[kind]) >= 4:  # merged as they come, so that memory holds distinct keys
                        parts[kind] = [merged(parts[kind])]
                held.append(piece)
                size += len(data)
                if size >= block_bytes:
                    yield from flush()
                    seq, size = seq + 1, 0
        if held:
            yield from flush()

    return docs.mapInArrow(make, ASKED)


# ---- the weighted tree ------------------------------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series after moving up by eight."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - math.log(math.pi) - _log_gamma(n0 + n1 + 1.0)


def _context(grams: np.ndarray, d: int) -> np.ndarray:
    return (grams >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)


def _bits(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heap numbers (1 to 255) of the eight decisions of each gram's byte, and the decided bits: grams x 8."""
    byte = grams & np.uint64(255)
    j = np.arange(8, dtype=np.uint64)
    heap = (np.uint64(1) << j) | (byte[:, None] >> (np.uint64(8) - j))
    return heap, ((byte[:, None] >> (np.uint64(7) - j)) & np.uint64(1)).astype(np.int64)


class Subtree:
    """Nodes of contexts of ``low`` to ``depth`` bytes for distinct grams with counts; zero counts only ask."""

    def __init__(self, grams: np.ndarray, uses: np.ndarray, low: int, depth: int):
        self.low, self.depth = low, depth
        heap, self.bit = _bits(grams)
        self.keys, self.at, self.n0, self.n1, self.weighted, self.own = {}, {}, {}, {}, {}, {}
        times = np.repeat(uses, 8).astype(np.float64)
        one = self.bit.ravel() == 1
        for d in range(depth, low - 1, -1):
            full = ((_context(grams, d) << np.uint64(8))[:, None] | heap).ravel()
            keys, at = np.unique(full, return_inverse=True)
            self.keys[d], self.at[d] = keys, at
            self.n0[d] = np.bincount(at, np.where(one, 0, times), len(keys))
            self.n1[d] = np.bincount(at, np.where(one, times, 0), len(keys))
            own = kt_log(self.n0[d], self.n1[d])
            if d == depth:
                self.weighted[d], self.own[d] = own, np.ones(len(keys))
                continue
            child = self.keys[d + 1]
            context = (child >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
            parent = np.searchsorted(keys, (context << np.uint64(8)) | (child & np.uint64(255)))
            below = np.bincount(parent, self.weighted[d + 1], len(keys))
            self.weighted[d] = np.logaddexp(own, below) - math.log(2)
            self.own[d] = np.exp(own - math.log(2) - self.weighted[d])

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each gram's bits at depth ``low`` mixed with what is deeper, and whether that node has counts.

        A node without counts is not in the tree: the mixture ends above it.
        """
        p, there = None, None
        one = self.bit.ravel() == 1
        for d in range(self.depth, self.low - 1, -1):
            at = self.at[d]
            n0, n1 = self.n0[d][at], self.n1[d][at]
            own = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)
            if p is None:
                p = own
            else:
                w = self.own[d][at]
                p = np.where(there, w * own + (1 - w) * p, own)
            there = (n0 + n1) > 0
        return p, there


def tree_top(top: list) -> tuple[np.ndarray, ...]:
    """Dense tables (own weight, n0, n1) of contexts of one byte and of none, from rows ``node, n0, n1, below``."""
    n0, n1, below = (np.zeros(65536) for _ in range(3))
    for r in top:
        n0[r["node"]], n1[r["node"]], below[r["node"]] = r["n0"], r["n1"], r["below"]
    own = kt_log(n0, n1)
    weighted = np.logaddexp(own, below) - math.log(2)
    w1 = np.exp(own - math.log(2) - weighted)
    m0, m1 = n0.reshape(256, 256).sum(0), n1.reshape(256, 256).sum(0)
    seen = (n0 + n1) > 0
    root_below = np.where(seen, weighted, 0.0).reshape(256, 256).sum(0)
    root = kt_log(m0, m1)
    w0 = np.exp(root - np.logaddexp(root, root_below))
    return w1, n0, n1, w0, m0, m1


def gram_scores(grams: np.ndarray, uses: np.ndarray, depth: int, top: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 probability of each gram's byte in its context."""
    tree = Subtree(grams, uses, 2, depth)
    p, there = tree.predict()
    heap, bit = _bits(grams)
    one = bit.ravel() == 1
    w1, n0, n1, w0, m0, m1 = top
    node = ((_context(grams, 1) << np.uint64(8))[:, None] | heap).ravel().astype(np.int64)
    a, b = n0[node], n1[node]
    own = (np.where(one, b, a) + 0.5) / (a + b + 1)
    p = np.where(there, w1[node] * own + (1 - w1[node]) * p, own)
    there = (a + b) > 0
    h = heap.ravel().astype(np.int64)
    own = (np.where(one, m1[h], m0[h]) + 0.5) / (m0[h] + m1[h] + 1)
    p = np.where(there, w0[h] * own + (1 - w0[h]) * p, own)
    return np.log10(p).reshape(-1, 8).sum(1)


# ---- Spark jobs -------------------------------------------------------------------------------------------------

class _Lookup:
    """Values of keys: a table of first slots for most, a binary search for the rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length() + 1))
        self.slot = np.zeros(1 << int(np.uint64(64) - self.shift), np.int64)
        self.slot[self._hash(self.keys)] = np.arange(len(keys))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.values[at]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of each row's values; every row has one at least."""
    return np.add.reduceat(values, at[:-1]) if len(at) > 1 else np.zeros(0)


def ctw_scores(docs: DataFrame, held_out=None, depth: int = 5, block_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: a row a document.

    Learns from documents where ``held_out`` (a column; default: crc32 of the id as text, modulo 7, is 2) is not true and
    scores all. A-Z are lower-cased. ``base_score`` is the add-one unigram log10 probability of words and the end
    token, ``score`` the context tree's of bytes and the end. Null texts are empty: an end token and no more. Null ids count
    as an empty text in the split; repeated ids keep a row each; other columns are ignored; an empty table gives an empty
    result. Words are told apart by a 64-bit hash.
    """
    rule = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(rule if held_out is None else held_out, F.lit(False)).alias("held_out"))
    folder = shared_path(docs.sparkSession, "blocks")
    asked = block_keys(rows, folder, depth, block_bytes)
    counts = written(asked.groupBy("kind", "key").agg(F.sum("uses").alias("uses"), F.collect_list("block").alias("blocks")), "counts")
    total = counts.where(F.col("kind") == TOKEN).agg(F.coalesce(F.sum("uses"), F.lit(0)), F.count_if(F.col("uses") > 0)).first()
    n_train, vocabulary = int(total[0]), int(total[1])

    pair = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    grams = counts.where(F.col("kind") == GRAM).select("key", "uses", "blocks", F.pmod(F.xxhash64(pair), F.lit(SUBTREES)).alias("tree"))

    def evidence(table: pa.Table) -> pa.Table:
        tree = Subtree(table.column("key").to_numpy().view(np.uint64), table.column("uses").to_numpy(), 2, depth)
        near = (tree.keys[2] >> np.uint64(8)) & np.uint64(255)
        node = ((near << np.uint64(8)) | (tree.keys[2] & np.uint64(255))).astype(np.int64)
        return pa.table({"node": node, "n0": tree.n0[2], "n1": tree.n1[2], "below": tree.weighted[2]})

    nodes = grams.drop("blocks").groupBy("tree").applyInArrow(lambda t: evidence(t), "node long, n0 double, n1 double, below double")
    # contexts of one byte x 255 decisions: 65,280 rows at most
    top = tree_top(nodes.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).collect())

    def answer(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        scores = gram_scores(keys, table.column("uses").to_numpy(), depth, top)
        return pa.table({"key": table.column("key"), "value": scores, "blocks": table.column("blocks")})

    values = grams.groupBy("tree").applyInArrow(lambda t: answer(t), "key long, value double, blocks array<long>")
    words = counts.where(F.col("kind") == TOKEN).select("key", F.col("uses").cast("double").alias("value"), "blocks")
    told = values.withColumn("kind", F.lit(GRAM)).unionByName(words.withColumn("kind", F.lit(TOKEN)))
    told = told.select(F.explode("blocks").alias("block"), "kind", "key", "value")
    scale = math.log10(n_train + vocabulary + 1)

    def score(block: int, table: pa.Table) -> pa.Table:
        kind, key, value = (table.column(c).to_numpy() for c in ("kind", "key", "value"))
        gram = _Lookup(key[kind == GRAM].view(np.uint64), value[kind == GRAM])
        word = _Lookup(key[kind == TOKEN].view(np.uint64), value[kind == TOKEN])
        out = []
        with open_read(_block_file(folder, block)) as f:
            pieces = list(pa.ipc.open_stream(f.read()))
        for batch in pieces:
            for i, n in text_slices(batch, max_bytes=2 << 20):
                piece = batch.slice(i, n)
                raw, off = text_bytes(piece.column("text"))
                data = LOWER_TABLE[raw]
                grams_, ga = byte_grams(data, off, depth)
                tokens, ta = row_tokens(data, off)
                uses = word(tokens)
                out.append(pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("held_out"), pa.array(np.diff(ta)),
                     pa.array(_sums((uses > 0).astype(np.int64), ta)), pa.array(np.full(n, n_train)),
                     pa.array(_sums(np.log10(uses + 1) - scale, ta)), pa.array(_sums(gram(grams_), ga))], names=names))
        return pa.Table.from_batches(out)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return told.groupBy("block").applyInArrow(
        lambda key, t: score(key[0].as_py(), t),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
