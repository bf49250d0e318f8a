"""Token ids as binary shards coded with a static range asymmetric numeral system (rANS).

A shard holds the ids of documents in order, an end id after each. All blocks of a shard share one frequency table.
A block codes ``LANES * STEPS`` ids in interleaved lanes; it starts from its own states, has a checkpoint (states and
word position) every ``CHECK`` steps and a checksum, so blocks, or parts from a checkpoint on, decode on their own.

Layout: magic, header length (uint32), header (JSON: sections with offset, stored bytes, CRC-32; blocks), sections.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabprobe.llm.common import shared_path, span_hashes, text_bytes, text_slices, written
from tabprobe.llm.files import open_read, open_write

MAGIC = b"RANSIDS1"
LANES, STEPS, CHECK = 1024, 512, 256
PRECISION = 18  # frequencies sum to 2 ** 18
LOW = np.uint64(1 << 31)  # states are kept in [2^31, 2^63), renormalised by words of 32 bits


# ---- frequency tables -------------------------------------------------------------------------------------------

def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to ``2 ** PRECISION``; every id that occurs keeps at least 1."""
    total, space = int(counts.sum()), 1 << PRECISION
    if total == 0:
        return np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) > space:
        raise ValueError(f"more than {space} different ids")
    freq = np.zeros(len(counts), np.int64)
    freq[used] = np.maximum(1, counts[used] * (space - len(used)) // total)
    over = int(freq.sum()) - space
    by_size = used[np.argsort(-counts[used], kind="stable")]
    if over <= 0:
        freq[by_size[0]] -= over
    for s in by_size:  # never more than the number of ids that were lifted to 1
        if over <= 0:
            break
        take = min(over, int(freq[s]) - 1)
        freq[s] -= take
        over -= take
    return freq


# ---- blocks -----------------------------------------------------------------------------------------------------

def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[bytes, list]:
    """The block's words and its checkpoints ``(step, word position, states)``, the first one at step 0.

    Coded from the last step to the first, so that decoding runs forward. Lane k holds ids k, k + LANES, ...
    """
    steps = -(-len(ids) // LANES)
    f, c = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    states = np.full(LANES, LOW, np.uint64)
    words, marks, n_words = [], [], 0
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min(len(ids), (t + 1) * LANES)
        x, ft = states[:b - a], f[a:b]
        full = x >= (ft << np.uint64(63 - PRECISION))
        if full.any():
            out = x[full]
            words.append((out & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            n_words += len(out)
            x = x.copy()
            x[full] = out >> np.uint64(32)
        q = x // ft
        states = states.copy()
        states[:b - a] = (q << np.uint64(PRECISION)) + (x - q * ft) + c[a:b]
        if t % CHECK == 0:
            marks.append((t, n_words, states))
    body = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return body.tobytes(), [(t, n_words - n, s) for t, n, s in marks[::-1]]


def decode_block(words: np.ndarray, states: np.ndarray, n_ids: int, symbol: np.ndarray, freq: np.ndarray,
                 start: np.ndarray) -> np.ndarray:
    """``n_ids`` ids from a checkpoint on: ``states`` there and the words from its position on."""
    mask, at = np.uint64((1 << PRECISION) - 1), 0
    states, out = states.copy(), np.empty(n_ids, np.uint32)
    for a in range(0, n_ids, LANES):
        x = states[:min(LANES, n_ids - a)]
        slot = x & mask
        s = symbol[slot]
        out[a:a + len(s)] = s
        x = freq[s] * (x >> np.uint64(PRECISION)) + slot - start[s]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[at:at + len(low)]
            at += len(low)
        states[:len(x)] = x
    return out


# ---- shards -----------------------------------------------------------------------------------------------------

def shard_bytes(ids: np.ndarray, lengths: np.ndarray, doc_ids: pa.Array) -> bytes:
    """A shard of documents with ``lengths`` ids each."""
    freq = frequency_table(np.bincount(ids) if len(ids) else np.zeros(1, np.int64))
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    sections, blocks, body = {}, [], []
    place = 0

    def put(data: bytes) -> list[int]:
        nonlocal place
        body.append(data)
        place += len(data)
        return [place - len(data), len(data), zlib.crc32(data)]

    sections["freq"] = put(zlib.compress(freq.astype("<u4").tobytes(), 6))
    sections["lengths"] = put(zlib.compress(lengths.astype("<u8").tobytes(), 6))
    sections["doc_ids"] = put(zlib.compress(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), 6))
    sections["nulls"] = put(zlib.compress(np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), 6))
    for a in range(0, len(ids), LANES * STEPS):
        part = ids[a:a + LANES * STEPS]
        words, marks = encode_block(part, freq, start)
        blocks.append({"first": a, "n": len(part), "words": put(words), "crc": zlib.crc32(part.astype("<u4").tobytes()),
                       "marks": [[t, w, put(s.astype("<u8").tobytes())] for t, w, s in marks]})
    header = json.dumps({"docs": len(lengths), "ids": len(ids), "sections": sections, "blocks": blocks}).encode()
    return MAGIC + len(header).to_bytes(4, "little") + header + b"".join(body)


class ShardReader:
    """Random access to a shard's bytes; every section, block and checkpoint is checked against its checksum."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a shard of ids")
        size = int.from_bytes(raw[8:12], "little")
        self.header, self.body = json.loads(raw[12:12 + size]), memoryview(raw)[12 + size:]
        sec = self.header["sections"]
        freq = np.frombuffer(zlib.decompress(self._get(sec["freq"])), "<u4").astype(np.int64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.lengths = np.frombuffer(zlib.decompress(self._get(sec["lengths"])), "<u8").astype(np.int64)
        n = self.header["docs"]
        null = np.unpackbits(np.frombuffer(zlib.decompress(self._get(sec["nulls"])), np.uint8), count=n).astype(bool)
        self.doc_ids = pa.array(np.frombuffer(zlib.decompress(self._get(sec["doc_ids"])), "<i8"), pa.int64(), mask=null)

    def _get(self, section: list[int]) -> memoryview:
        at, n, crc = section
        data = self.body[at:at + n]
        if zlib.crc32(data) != crc:
            raise ValueError("checksum mismatch")
        return data

    def block(self, i: int, checkpoint: int = 0) -> np.ndarray:
        """Ids of block ``i`` from its ``checkpoint`` on."""
        b = self.header["blocks"][i]
        step, position, states = b["marks"][checkpoint]
        words = np.frombuffer(self._get(b["words"]), np.uint32)[position:]
        ids = decode_block(words, np.frombuffer(self._get(states), "<u8"), b["n"] - step * LANES, self.symbol, self.freq, self.start)
        if checkpoint == 0 and zlib.crc32(ids.tobytes()) != b["crc"]:
            raise ValueError("checksum mismatch")
        return ids

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids with the end id) of each document, block by block."""
        held, doc = np.zeros(0, np.uint32), 0
        for i in range(len(self.header["blocks"])):
            held, at = np.concatenate([held, self.block(i)]), 0
            while doc < len(self.lengths) and at + self.lengths[doc] <= len(held):
                yield doc, held[at:at + self.lengths[doc]]
                at += self.lengths[doc]
                doc += 1
            held = held[at:]


# ---- tokenizer --------------------------------------------------------------------------------------------------

#: Marks that the split pattern never joins to the letter or digit before them.
_MARKS = np.isin(np.arange(256), list(b".,;:!?)"))


class SplitTokenizer:
    """Ids of a byte-level BPE file, each distinct unit of text encoded once.

    The file's split pattern always has a boundary before a single space or line break between two characters that are
    not white space, after such a line break, and between a letter or digit and the mark that ends a word, so a text's
    ids are those of its units. Units are told apart by two independent 64-bit hashes.
    """

    def __init__(self, path: str, max_known: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.max_known = max_known
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        """``slot`` of each known unit (by ``keys``, sorted, and ``check``): its ids are ``flat[ends[slot]:ends[slot + 1]]``."""
        self.keys, self.check, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode_units(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units one after the other, and the number of ids of each.

        Units that begin with a space and have no line break are joined by line breaks in runs of 64, as a line break
        before a space is always an id of its own; a run whose breaks don't show that is encoded unit by unit.
        """
        lens = stops - starts
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        solid = (data > 0x20) & (data < 0x7F)
        solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)  # where white space can't be
        second = data[np.minimum(starts + 1, len(data) - 1)]
        plain = (breaks[stops] == breaks[starts]) & (lens > 1) & (data[starts] == 0x20) & solid[stops - 1]
        plain &= (second > 0x20) & (second < 0x7F) | (second == 0xC3)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n_plain, size = int(plain.sum()), np.zeros(len(starts), np.int64)
        ends = np.cumsum(lens[order] + 1)
        text = np.full(int(ends[-1]) if len(ends) else 0, 0x0A, np.uint8)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = data[np.repeat(starts[order] - ends + lens[order] + 1, lens[order]) + np.flatnonzero(inside)]
        raw, begins = text.tobytes(), ends - lens[order] - 1

        def one_by_one(first: int, last: int) -> list[list[int]]:
            units = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begins[first:last].tolist(), (ends[first:last] - 1).tolist(), strict=True)]
            return [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]

        ids: list[np.ndarray] = []
        edges = [*range(0, n_plain, 64), n_plain] if n_plain else []
        runs = [raw[begins[a]:ends[b - 1]].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]
        for a, b, e in zip(edges, edges[1:], self.tok.encode_batch_fast(runs, add_special_tokens=False), strict=False):
            x = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(x == self.newline[0])
            if len(cuts) == b - a and len(self.newline) == 1:
                size[order[a:b]] = np.diff(cuts, prepend=-1) - 1
                ids.append(np.delete(x, cuts))
            else:
                each = one_by_one(a, b)
                size[order[a:b]] = [len(u) for u in each]
                ids += [np.array(u, np.uint32) for u in each]
        if n_plain < len(order):
            each = one_by_one(n_plain, len(order))
            size[order[n_plain:]] = [len(u) for u in each]
            ids += [np.array(u, np.uint32) for u in each]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        # back to the order in which the units were given
        at = np.empty(len(order), np.int64)
        at[order] = np.concatenate([[0], np.cumsum(size[order])[:-1]])
        return flat[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(flat))], size

    def _learn(self, keys: np.ndarray, check: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Encodes new units, whose ``keys`` are sorted, and returns their slots."""
        ids, size = self._encode_units(data, starts, stops)
        slot = len(self.ends) - 1 + np.arange(len(keys))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.check, self.slot = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.check, check), (self.slot, slot)))
        return slot

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows' texts one after the other, and the n + 1 offsets of the rows."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        # cut before a single space between bytes of words; bytes over 0x7F are only taken where no white space has them
        solid = (data > 0x20) & (data < 0x7F) | (data == 0xC3)
        after = (data > 0x20) & (data < 0x7F)
        after[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 0x20) & after[:-2] & solid[2:]
        edges = off[(off > 0) & (off < len(data))]
        cut[edges] = False
        cut[edges - 1] = False
        # between a letter or digit and a mark that can't go on with it; on both sides of a line break between words
        word = (data >= 0x30) & (data <= 0x39) | ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
        word[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] |= _MARKS[data[1:]] & word[:-1]
        line = data == 0x0A
        cut[1:] |= line[1:] & after[:-1]
        cut[2:] |= solid[2:] & line[1:-1] & after[:-2]
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut)
        stops = np.concatenate([starts[1:], [len(data)]])
        first = span_hashes(data, starts, stops)
        second = span_hashes(data ^ np.uint8(0x5A), starts, stops)
        keys, where, which = np.unique(first, return_index=True, return_inverse=True)
        same = second[where][which] == second
        if len(self.keys) > self.max_known:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        at_ok = np.minimum(at, max(0, len(self.keys) - 1))
        known = (self.keys[at_ok] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if known.any():
            clash = known.copy()
            clash[known] = self.check[at_ok[known]] != second[where[known]]
            same &= ~clash[which]
        slot = np.zeros(len(keys), np.int64)
        slot[known] = self.slot[at_ok[known]]
        new = np.flatnonzero(~known)
        if len(new):
            slot[new] = self._learn(keys[new], second[where[new]], data, starts[where[new]], stops[where[new]])
        unit = slot[which]
        extra: dict[int, np.ndarray] = {}
        lens = (self.ends[1:] - self.ends[:-1])[unit]
        for i in np.flatnonzero(~same).tolist():  # two units with one hash: encoded by themselves
            extra[i] = np.array(self.tok.encode(data[starts[i]:stops[i]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            lens[i] = len(extra[i])
        ends = np.cumsum(lens)
        total = int(ends[-1])
        source = np.arange(total, dtype=np.int64) + np.repeat(self.ends[:-1][unit] - (ends - lens), lens)
        ids = self.flat[np.minimum(source, len(self.flat) - 1)] if len(self.flat) else np.zeros(total, np.uint32)
        for i, x in extra.items():
            ids[ends[i] - lens[i]:ends[i]] = x
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(starts, off)]


@functools.lru_cache(maxsize=1)
def shared_tokenizer(path: str) -> SplitTokenizer:
    """The tokenizer of a worker process: tasks that it runs one after another share the units known."""
    return SplitTokenizer(path)


# ---- Spark jobs -------------------------------------------------------------------------------------------------

MANIFEST = "part long, seq long, path string, docs long, ids long, stored long"
DOCS = "part long, seq long, row long, doc_id long, inside long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, tokenizer_path: str | Callable[[], str], order: list, end_id: int = 0,
                 shard_ids: int = 4_000_000, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Writes ids of ``docs`` (``doc_id``, ``text``) in ``order`` to shards of about ``shard_ids`` ids; returns the manifest.

    The manifest has a row a shard, ordered by ``part, seq``; it names the files of committed tasks only, so a task that
    runs twice leaves an unnamed file and no wrong row. Rows are dealt out by ranges of ``order``.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        path = tokenizer_path() if callable(tokenizer_path) else tokenizer_path
        tok, part, seq = shared_tokenizer(path), TaskContext.get().partitionId(), 0
        ids, lengths, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, names, held, seq
            raw = shard_bytes(np.concatenate(ids), np.concatenate(lengths), pa.concat_arrays(names))
            file = f"{folder}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.rans"
            with open_write(file) as out:
                out.write(raw)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": file, "docs": sum(map(len, lengths)),
                                               "ids": held, "stored": len(raw)}])
            ids, lengths, names, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for i, n in text_slices(batch):
                piece = batch.slice(i, n)
                x, at = tok.encode(*text_bytes(piece.column("text")))
                ids.append(np.insert(x, at[1:], end_id))
                lengths.append(np.diff(at) + 1)
                names.append(piece.column("doc_id"))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield flush()
        if lengths:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    keys = [f"__o{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return written(dealt.sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(write, MANIFEST), "ids-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row a document, from the files: ``doc_id, start, n_tokens, ids_crc32``; a shard is one task's unit of work."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                with open_read(shard["path"]) as f:
                    reader = ShardReader(f.read())
                crc = np.zeros(len(reader.lengths), np.int64)
                for i, ids in reader.documents():
                    crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard["part"])), pa.array(np.full(n, shard["seq"])), pa.array(np.arange(n)),
                     reader.doc_ids, pa.array(np.cumsum(reader.lengths) - reader.lengths), pa.array(reader.lengths), pa.array(crc)],
                    names=["part", "seq", "row", "doc_id", "inside", "n_tokens", "ids_crc32"])

    before = F.sum("ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))  # a row a shard
    bases = manifest.select("part", "seq", F.coalesce(before, F.lit(0)).alias("base"))
    # a shard a task: a given number of partitions is not merged for being few bytes of paths
    decoded = manifest.repartition(max(1, manifest.count()), F.col("path")).mapInArrow(read, DOCS)
    return decoded.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def byte_bpe_path() -> str:
    """The public byte-level BPE file, as installed where the task runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_shards(docs: DataFrame, tokenizer_path: str | Callable[[], str] = byte_bpe_path, order: list | None = None,
                 **writing) -> DataFrame:
    """Writes all documents' ids as rANS shards and reads them back: ``doc_id, start, n_tokens, ids_crc32``.

    ``order`` (default: ascending ``doc_id``, nulls first) is the order of documents in the files. A null text has the
    end id only; repeated ids stay rows of their own, in any order; other columns are ignored; an empty table writes nothing.
    """
    order = order or [F.col("doc_id").cast("long")]
    return read_shards(write_shards(docs, tokenizer_path, order, **writing))
