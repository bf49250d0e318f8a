"""Spelling variants: a bit-sliced position index over the vocabulary finds all words one edit apart.

1. Words and their counts come from whole texts in one pass over their bytes, added up in each slice before the shuffle.
2. Of a pair one edit apart, whose longer word has M letters, the first or the last M div 2 letters are the same. Each
   word goes to the groups of its beginning and of its end, for M its own length and one more. A pair belongs to the group
   of the beginning if that is the same, and else to that of the end, so it is met once.
3. A group of more than ``HOT`` words is cut again: what its words leave open is halved in the same way, until one letter
   is open. No group is cut off and no pair is lost.
4. Groups are packed into blocks of words. For each (open position, letter) of a block a bitset tells which words have the
   letter there. For each word, 64 others at a time, three sets move along its letters: words without an error so far,
   with one letter replaced, and with one letter of it missing (whose letters stand one position before).

Null and empty texts have no words; a null ``doc_id`` counts as an empty one where letters are deleted; repeated rows
count again; columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import LOWER_TABLE, salted_lookup, text_bytes, text_slices, written

HOT, BLOCK = 2048, 1024
#: More words than can differ in one letter only: 90 letters, and none.
UNCUT = 128
#: Words longer than so many bytes are hashed one by one.
LONG = 64


# ---- words of texts ---------------------------------------------------------------------------------------------

def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all runs ``[A-Za-z\\u00C0-\\u00FF]+`` one after another, their n + 1 offsets, and the row of each."""
    letter = ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    lead = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF are 0xC3 and one byte more
    letter[lead] = True
    letter[lead + 1] = True
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = off[(off > 0) & (off < len(data))]
    begins[edges] = letter[edges]
    starts = np.flatnonzero(begins)
    before = np.concatenate([[0], np.cumsum(letter)])
    return data[letter], np.append(before[starts], before[-1]), np.searchsorted(off, starts, side="right") - 1


def crc_of(data: np.ndarray, off: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, going on from the CRC-32 ``first`` of what stands before it."""
    lens = np.diff(off)
    out = ~first.astype(np.uint32)
    for d in range(min(int(lens.max(initial=0)), LONG)):
        on = np.flatnonzero(lens > d)
        out[on] = CRC[(out[on] ^ data[off[on] + d]) & 0xFF] ^ (out[on] >> 8)
    out = ~out
    for k in np.flatnonzero(lens > LONG).tolist():
        out[k] = zlib.crc32(data[off[k] + LONG:off[k + 1]], int(out[k]))
    return out


def spelled(data: np.ndarray, off: np.ndarray, ids: list[str], every: int = 31) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased runs of all texts, one letter less where ``every`` divides the CRC-32, and their lengths in letters."""
    runs, edge, row = letter_runs(LOWER_TABLE[data], off)
    prefix = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in ids), np.uint32, len(ids))
    h = crc_of(runs, edge, prefix[row])
    char = (runs & 0xC0) != 0x80
    at = np.flatnonzero(char)
    upto = np.concatenate([[0], np.cumsum(char)])
    size = np.diff(upto[edge])
    cut = np.flatnonzero(h % every == 0)
    gone = at[upto[edge[cut]] + h[cut] % size[cut]]
    keep = np.ones(len(runs), bool)
    keep[gone] = False
    wide = gone[runs[gone] == 0xC3]
    keep[wide + 1] = False
    size[cut] -= 1
    ends = np.concatenate([[0], np.cumsum(keep)])[edge]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(runs[keep].tobytes())), size


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2) -> DataFrame:
    """``word, n, len``: words of at least ``least`` letters found ``times`` times or more."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n in text_slices(batch):
                part = batch.slice(i, n)
                words, size = spelled(*text_bytes(part.column("text")), part.column("doc_id").to_pylist())
                found = pc.value_counts(words.filter(pa.array(size >= least)))
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    slim = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = slim.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)
    return counts.withColumn("len", F.length("word"))


# ---- groups -----------------------------------------------------------------------------------------------------

def halves(open_: DataFrame) -> DataFrame:
    """Each row goes to the two groups that fix half of what is open: ``word, n, len, m, l, s, hi``.

    Words of a group are of ``m`` letters, or one less, and share the first ``l`` and the last ``s``; their first
    difference is before ``hi``. Rows of one open letter are as they are.
    """
    cut = open_.withColumn("f", F.expr("m - l - s")).withColumn("half", F.expr("f div 2"))
    side = F.explode(F.array(F.lit(False), F.lit(True))).alias("late")
    out = cut.select("*", side).select("word", "n", "len", "m", F.expr("CAST(l + if(late, 0, half) AS int)").alias("l"),
                                       F.expr("CAST(s + if(late, half, 0) AS int)").alias("s"),
                                       F.expr("CAST(if(late, least(hi, l + half), hi) AS int)").alias("hi"))
    return out.where("l < hi")


def grouped(rows: DataFrame) -> DataFrame:
    """Adds the group's ``key`` and what is open of the word, ``middle``: as many letters as are open in the longer words.

    In a shorter word the last one is the first of the shared end, which tells where it first differs.
    """
    return (rows.withColumn("key", F.expr("concat_ws(':', m, l, s, hi, substring(word, 1, l), if(s = 0, '', substring(word, len - s + 1, s)))"))
            .withColumn("middle", F.expr("substring(word, l + 1, m - l - s)")))


def bitsets(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct value the packed set of the rows that have it, and each row's value as an index into them."""
    kinds, at = np.unique(values, return_inverse=True)
    rows = np.zeros((len(kinds), -(-len(values) // 64) * 64), np.uint8)
    rows[at, np.arange(len(values))] = 1
    return np.packbits(rows, axis=1, bitorder="little").view(np.uint64), at


def one_error(letters: np.ndarray, size: np.ndarray, group: np.ndarray, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j): in one group, j is i with one letter replaced or one letter less, first differing before ``hi``.

    ``letters`` has the open letters of each word, ``size`` their number: as many as there are columns, or one less; the
    last column then has the letter that follows, or 0.
    """
    full = letters.shape[1]
    ask = np.flatnonzero(size == full)
    if len(ask) == 0:
        return ask, ask
    sets, at = bitsets(group)
    exact = sets[at[ask]]
    replaced, missing = np.zeros_like(exact), np.zeros_like(exact)
    prior, both = None, None
    for t in range(full):
        sets, at = bitsets(letters[:, t])
        here = sets[at[ask]]
        if prior is not None:  # the letter asked for, one position before
            place = np.searchsorted(prior[0], letters[ask, t])
            known = (place < len(prior[0])) & (prior[0][np.minimum(place, len(prior[0]) - 1)] == letters[ask, t])
            missing &= np.where(known[:, None], prior[1][np.minimum(place, len(prior[0]) - 1)], np.uint64(0))
        if t < hi:
            missing |= exact
            replaced = replaced & here | exact & ~here
        else:
            replaced &= here
        exact = exact & here
        if t + 1 == hi:
            both = exact  # words that are the same up to ``hi`` are met in another group
        prior = (np.unique(letters[:, t]), sets)
    sets, at = bitsets(size)
    kinds = np.unique(size).tolist()
    none = np.zeros(exact.shape[1], np.uint64)
    found = replaced & sets[kinds.index(full)] | missing & (sets[kinds.index(full - 1)] if full - 1 in kinds else none)
    if both is not None:
        found &= ~both
    i, j = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"))
    return ask[i], j


def _codes(middle: pa.Array, width: int) -> np.ndarray:
    """Letters as numbers, one row a word, 0 behind the end."""
    text = middle.cast(pa.string()).to_numpy(zero_copy_only=False).astype(f"U{max(width, 1)}")
    return text.view(np.uint32).reshape(len(text), max(width, 1))[:, :width].astype(np.uint16)


def near_words(groups: DataFrame, hot: int, block: int) -> DataFrame:
    """``word, n_near, near, near_n`` of each word of a block with near ones: how many, and the most frequent one.

    Rows of hot groups are passed on as they come, with the group's ``m, l, s, hi`` and no near word. At most ``hot`` rows of
    a group and ``block`` more are held.
    """
    names = ["word", "n", "len", "m", "l", "s", "hi", "n_near", "near", "near_n"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in t.select(names[:7]).to_batches():
                none = [pa.nulls(b.num_rows, k) for k in (pa.int64(), pa.string(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *none], names)

        def best(t: pa.Table, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(i) == 0:
                return
            n, size = t.column("n").to_numpy(), t.column("len").to_numpy()
            once = size[j] < size[i]  # words of one length have found each other
            i, j = np.concatenate([i, j[once]]), np.concatenate([j, i[once]])
            rank = np.empty(t.num_rows, np.int64)
            rank[pc.sort_indices(t, sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()] = np.arange(t.num_rows)
            order = np.lexsort((rank[j], i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            count = np.diff(np.append(first, len(i)))
            mine = t.take(pa.array(i[first])).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*[mine.column(c).combine_chunks() for c in ("word", "n", "len")], *[pa.nulls(len(first), pa.int32())] * 4, pa.array(count),
                 t.column("word").combine_chunks().take(pa.array(j[first])), pa.array(n[j[first]])], names)

        def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole groups; those of one shape are packed into blocks."""
            t = t.combine_chunks()
            key = pc.dictionary_encode(t.column("key")).combine_chunks().indices.to_numpy()
            shape = {c: t.column(c).to_numpy() for c in ("m", "l", "s", "hi", "len")}
            asks = np.bincount(key, weights=shape["len"] == shape["m"])
            some = (np.bincount(key)[key] > 1) & (asks[key] > 0)
            width, hi = shape["m"] - shape["l"] - shape["s"], shape["hi"] - shape["l"]
            at = np.flatnonzero(some)
            at = at[np.lexsort((key[at], hi[at], width[at]))]
            i, reach = 0, block + max(hot, UNCUT)
            while i < len(at):
                same = (width[at[i:i + reach]] == width[at[i]]) & (hi[at[i:i + reach]] == hi[at[i]])
                end = i + (len(same) if same.all() else int(np.argmin(same)))
                new = np.flatnonzero(np.diff(key[at[i:end]])) + 1  # where groups end
                fits = new[new <= block]
                if end - i > block and len(new):
                    end = i + int(fits[-1] if len(fits) else new[0])
                mine = t.take(pa.array(at[i:end])).combine_chunks()
                w = int(width[at[i]])
                size = (mine.column("len").to_numpy() - mine.column("l").to_numpy() - mine.column("s").to_numpy()).astype(np.int64)
                yield from best(mine, *one_error(_codes(mine.column("middle").combine_chunks(), w), size, key[at[i:end]], int(hi[at[i]])))
                i = end

        def last_run(t: pa.Table) -> int:
            key = t.column("key")
            same = pc.equal(key, key[-1]).to_numpy()
            return 0 if same.all() else len(same) - int(np.argmin(same[::-1]))

        held, passing = None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if t.num_rows and passing is not None:  # a hot group that has been passed on goes on
                same = pc.equal(t.column("key"), passing).to_numpy()
                n = len(same) if same.all() else int(np.argmin(same))
                yield from passed(t.slice(0, n))
                t = t.slice(n)
                if t.num_rows:
                    passing = None
            if t.num_rows == 0:
                continue
            held = t if held is None else pa.concat_tables([held, t])
            cut = last_run(held)
            for part, whole in ((held.slice(0, cut), True), (held.slice(cut), False)):
                if part.num_rows == 0:
                    continue
                key = pc.dictionary_encode(part.column("key").combine_chunks())
                sizes = np.bincount(key.indices.to_numpy())
                cuttable = part.column("m").to_numpy() - part.column("l").to_numpy() - part.column("s").to_numpy() > 1
                big = (sizes[key.indices.to_numpy()] > hot) & cuttable
                if whole:
                    yield from passed(part.filter(pa.array(big)))
                    yield from links(part.filter(pa.array(~big)))
                    held = None
                elif big.all():
                    yield from passed(part)
                    held, passing = None, part.column("key")[-1]
                else:
                    held = part
        if held is not None:
            yield from links(held)

    dealt = groups.select("key", "middle", *names[:7]).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(solve, "word string, n long, len int, m int, l int, s int, hi int, n_near long, near string, near_n long")


def near_of(words: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``word, n_near, near, near_n`` of all words (``word, n, len``) with near ones: their number and the most frequent one.

    Ties go to the smaller word in code-point order.
    """
    m = F.explode(F.array("len", F.col("len") + 1)).alias("m")
    zero = F.lit(0)
    left = halves(words.select("word", "n", "len", m, zero.alias("l"), zero.alias("s")).withColumn("hi", F.col("m")))
    found = None
    while True:
        got = written(near_words(grouped(left), hot, block), "spelling")
        pairs = got.where("n_near IS NOT NULL").select("word", "n_near", "near", "near_n")
        found = pairs if found is None else found.unionByName(pairs)
        left = halves(got.where("n_near IS NULL").select("word", "n", "len", "m", "l", "s", "hi"))
        if left.isEmpty():
            break
    top = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", "top.near", (-F.col("top.minus")).alias("near_n"))


def spelling_variants(docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each word of ``docs``.

    ``form`` is the most frequent word one edit away if it is ``ratio`` times as frequent; ``root`` is where forms lead.
    """
    words = written(vocabulary(docs, least, times), "words")
    near = written(near_of(words, hot, block), "near")
    out = words.drop("len").join(near, "word", "left")
    better = F.col("near_n") >= ratio * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("near")).alias("form"),
                             F.when(better, F.col("near_n")).alias("form_n")), "forms")
    # each step on a way is ``ratio`` times as frequent, so ways are short; they are doubled until all have ended
    ways = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        more = salted_lookup(ways, ways.select(F.col("word").alias("root"), F.col("root").alias("next")), ["root"], "left", salts=8)
        ways = written(more.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not ways.where("moved").isEmpty()
        ways = ways.drop("moved")
        if not moved:
            break
    return out.join(ways, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
