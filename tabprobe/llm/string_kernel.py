"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares the ``ORDER``-letter subsequences of two words, also with gaps, inside ``SPAN`` letters; each
letter of a gap costs a factor ``DECAY``. So ``idi.ot`` and ``idxiot`` still share most of ``idiot``. Landmarks are words
of the training texts; a word's features are its kernels with them, whitened by the landmarks' own kernel (Nyström).

Labels are given for whole texts: a text is as toxic as its most toxic sentence, a sentence as its most toxic word, so
the machine is trained on witness words that are chosen anew in each round. As the kernel is a sum over subsequences, the
trained machine is a table of subsequence weights: scoring is a look-up for each letter and gap pattern, without joins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import LOWER_TABLE, text_bytes, text_slices, written

ORDER, SPAN, DECAY = 4, 6, 0.5
BITS = 6  # a letter's code; 0 is between words
EDGE = 63  # counts as a letter at both ends of a word
PATTERNS = [(0, *p) for p in combinations(range(1, SPAN), ORDER - 1)]

#: Letters a-z are 1 to 26, bytes over 0x7F (but the lead byte 0xC3) 27 to 58; white space is 0, all else is left out.
_DROP = 255
_CODE = np.full(256, _DROP, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:256] = 27 + (np.arange(128, 256) & 31)
_CODE[0xC3] = _DROP
_CODE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


def letter_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all rows with a 0 after each word, the starts of words, and n + 1 word offsets of the rows.

    Characters that are no letters vanish, so a word is whole with dots or digits inside it; runs of words of one letter
    (``i d i o t``) are joined. Rows never share a word.
    """
    full = np.insert(LOWER_TABLE[data], off[1:], 0x20)
    last = np.zeros(len(full), bool)
    last[off[1:] + np.arange(len(off) - 1)] = True
    code = _CODE[full]
    keep = code != _DROP
    code, last = code[keep], last[keep]
    # one 0 after each word; a row's end stays
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | last[1:]
    keep[:1] = (code[:1] != 0) | last[:1]
    code, last = code[keep], last[keep]
    zero = np.flatnonzero(code == 0)
    length = np.diff(zero, prepend=-1) - 1
    single = length == 1
    joined = zero[:-1][single[:-1] & single[1:] & ~last[zero[:-1]]]
    keep = np.ones(len(code), bool)
    keep[joined] = False
    code, last = code[keep], last[keep]
    ends = np.flatnonzero(code == 0)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    rows = np.searchsorted(ends, np.flatnonzero(last), side="right")
    return code, starts, np.concatenate([[0], rows])


def subsequences(word: bytes) -> Counter:
    """The word's features, with a letter for either end: weight of each subsequence code."""
    out: Counter = Counter()
    word = bytes([EDGE, *word, EDGE])
    n = len(word)
    for i in range(n - ORDER + 1):
        for p in PATTERNS:
            if i + p[-1] < n:
                u = 0
                for k in p:
                    u = u << BITS | word[i + k]
                out[u] += DECAY ** (p[-1] - ORDER + 1)
    return out


def kernel(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    return sum(v * b[u] for u, v in a.items() if u in b)


@dataclass
class StringKernelModel:
    """Subsequence weights, the bias, and the scale of margins to scores."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def table(self) -> np.ndarray:
        out = np.zeros(1 << (BITS * ORDER), np.float32)
        out[self.codes] = self.weights
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -60, 60)))


def word_values(code: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The weights of all subsequences of each word, added up."""
    if len(starts) == 0:
        return np.zeros(0, np.float32)
    copies = np.where(code == 0, 3, 1)  # a 0 becomes an edge, a 0 and the next word's edge
    at = (np.cumsum(copies) - 1)[code == 0]
    code = np.repeat(code, copies)
    code[at - 2] = code[at] = EDGE
    code = np.concatenate([[EDGE], code[:-1]]).astype(np.uint8)
    starts = np.concatenate([[0], at[:-1] + 1])
    n = len(code)
    c = np.concatenate([code, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    word = np.concatenate([np.cumsum(code == 0), np.full(SPAN, -1)]).astype(np.int32)
    shifted = [[c[k:k + n] << (BITS * (ORDER - 1 - q)) for k in range(SPAN)] for q in range(ORDER)]
    same = [word[k:k + n] == word[:n] for k in range(SPAN)]
    total = np.zeros(n, np.float32)
    for last in range(ORDER - 1, SPAN):
        part = np.zeros(n, np.float32)
        for p in PATTERNS:
            if p[-1] == last:
                u = shifted[0][0] | shifted[1][p[1]]
                u |= shifted[2][p[2]]
                u |= shifted[3][last]
                part += table[u]
        # a word's end counts as the next word's: it has no letters and adds nothing
        part *= same[last]
        total += part * np.float32(DECAY ** (last - ORDER + 1))
    total[code == 0] = 0
    return np.add.reduceat(total, starts)


def row_margins(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The largest value of each row's words; every row has one at least, if only an empty one."""
    return np.maximum.reduceat(values, rows[:-1]) if len(rows) > 1 else np.zeros(0)


# ---- training ---------------------------------------------------------------------------------------------------

def _words(code: np.ndarray, starts: np.ndarray) -> list[bytes]:
    return code.tobytes().split(b"\0")[:len(starts)]


def word_label_counts(sample: DataFrame) -> DataFrame:
    """``word, pos, neg``: in how many sampled texts of each label a word is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, neg = Counter(), Counter()
            for i, n in text_slices(batch):
                piece = batch.slice(i, n)
                code, starts, rows = letter_words(*text_bytes(piece.column("text")))
                words, toxic = _words(code, starts), piece.column("toxic").to_pylist()
                for k in range(n):
                    (pos if toxic[k] else neg).update({w for w in words[rows[k]:rows[k + 1]] if len(w) >= ORDER})
            every = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([pos[w] for w in every], pa.int64()),
                                              pa.array([neg[w] for w in every], pa.int64())], names=["word", "pos", "neg"])

    return sample.mapInArrow(count, "word binary, pos long, neg long").groupBy("word").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def witnesses(sample: DataFrame, model: StringKernelModel, per_text: int) -> DataFrame:
    """``toxic, rank, word, value``: the ``per_text`` words of highest value in each sampled text."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            out = []
            for i, n in text_slices(batch, max_bytes=1 << 20):
                piece = batch.slice(i, n)
                code, starts, rows = letter_words(*text_bytes(piece.column("text")))
                values, words, toxic = word_values(code, starts, table), _words(code, starts), piece.column("toxic").to_pylist()
                for k in range(n):
                    a, b = rows[k], rows[k + 1]
                    best: dict[bytes, float] = {}
                    for j in a + np.argsort(-values[a:b], kind="stable"):
                        best.setdefault(words[j], float(values[j]))
                        if len(best) == per_text:
                            break
                    out += [{"toxic": toxic[k], "rank": r, "word": w, "value": v} for r, (w, v) in enumerate(best.items())]
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("toxic", pa.int32()), ("rank", pa.int32()), ("word", pa.binary()), ("value", pa.float64())])
    return sample.mapInArrow(pick, "toxic int, rank int, word binary, value double")


def landmark_candidates(counts: DataFrame, n_pos: int, n_neg: int, least: int) -> DataFrame:
    """``word, rating``: words that toxic texts have at least four times as often as others.

    The rating is the log likelihood ratio of the word's texts against the shares of the labels (Dunning, 1993), so a word
    of few toxic texts and no other stands before an ordinary one that a few more have.
    """
    pos, neg = F.col("pos"), F.col("neg")
    share = n_pos / (n_pos + n_neg)
    rated = counts.where((pos >= least) & (pos * (n_neg + 1) >= 4 * (neg + 0.25) * (n_pos + 1)))
    gain = pos * F.log(pos / ((pos + neg) * share)) + F.when(neg > 0, neg * F.log(neg / ((pos + neg) * (1 - share)))).otherwise(0.0)
    return rated.select("word", (2 * gain).alias("rating"))


def choose_landmarks(words: list[bytes], most: int, alike: float) -> list[bytes]:
    """The first ``most`` words that are not too alike one chosen before."""
    chosen: list[tuple[bytes, Counter, float]] = []
    for word in words:
        f = subsequences(bytes(word))
        own = kernel(f, f)
        if all(kernel(f, g) < alike * (own * o) ** 0.5 for _, g, o in chosen):
            chosen.append((bytes(word), f, own))
        if len(chosen) == most:
            break
    return [w for w, _, _ in chosen]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 1.0)
    ridge[-1] = 1e-4
    for _ in range(rounds):
        m = y * (z @ w)
        on = m < 1
        grad = ridge * w - 2 * c * (z[on] * ((1 - m[on]) * y[on] * weight[on])[:, None]).sum(0)
        hess = np.diag(ridge) + 2 * c * (z[on] * weight[on][:, None]).T @ z[on]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def logistic_scale(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities; the slope is positive."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, s = p - y, p * (1 - p) + 1e-9
        grad = np.array([(d * margin).sum() + 1e-2 * (a - 1), d.sum()])
        hess = np.array([[(s * margin * margin).sum() + 1e-2, (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(1e-3, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(sample: DataFrame, landmarks: int = 128, alike: float = 0.6, rounds: int = 3, c: float = 0.2, candidates: int = 20) -> StringKernelModel:
    """A model from a bounded sample ``text, toxic`` (0 or 1). With one label only, its score is that label throughout.

    Landmarks are chosen from the ``candidates * landmarks`` best rated words of the sample's toxic texts.

    The driver gets the words that mark toxic texts, then a few witness words a sampled text: both bounded by the sample.
    """
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = StringKernelModel(np.zeros(1, np.int64), np.zeros(1, np.float32))
    if not sizes.get(1) or not sizes.get(0):
        none.bias = 60.0 if sizes.get(1) else -60.0
        return none
    least = max(2, sizes[1] // 400)
    rated = landmark_candidates(word_label_counts(sample), sizes[1], sizes[0], least)
    best = rated.orderBy(F.desc("rating"), "word").limit(candidates * landmarks).collect()
    marks = choose_landmarks([bytes(r["word"]) for r in best], landmarks, alike)
    if not marks:
        none.shift = float(np.log(sizes[1] / sizes[0]))
        return none
    features = [subsequences(w) for w in marks]
    norms = np.array([kernel(f, f) ** 0.5 for f in features])
    own = np.array([[kernel(f, g) for g in features] for f in features]) / np.outer(norms, norms)
    values, vectors = np.linalg.eigh(own)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T

    def model(alpha: np.ndarray, bias: float) -> StringKernelModel:
        table: Counter = Counter()
        for f, a, norm in zip(features, alpha, norms, strict=True):
            for u, v in f.items():
                table[u] += a * v / norm
        return StringKernelModel(np.array(list(table), np.int64), np.array(list(table.values()), np.float32), bias)

    known: dict[bytes, np.ndarray] = {}

    def kernels(word: bytes) -> np.ndarray:
        if word not in known:
            f = subsequences(word)
            known[word] = np.array([kernel(f, g) for g in features]) / norms
        return known[word]

    now = model(np.ones(len(marks)), 0.0)
    for _ in range(rounds):
        found = witnesses(sample, now, 3).collect()
        # a toxic text needs one toxic word; all words of the others are clean
        picked = [r for r in found if r["toxic"] == 0 or r["rank"] == 0]
        x = np.array([kernels(bytes(r["word"])) for r in picked]) @ whiten
        y = np.array([1.0 if r["toxic"] else -1.0 for r in picked])
        weight = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum()) * len(y) / 2
        w, bias = squared_hinge(x, y, weight / len(y), c * len(y))
        now = model(whiten @ w, bias)
    final = [r for r in witnesses(sample, now, 1).collect()]
    now.slope, now.shift = logistic_scale(np.array([r["value"] for r in final]) + now.bias, np.array([float(r["toxic"]) for r in final]))
    return now


# ---- Spark jobs -------------------------------------------------------------------------------------------------

def held_out_rule(modulo: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulo``, is 0; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(modulo)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, toxic`` of at most ``most`` labelled training texts of each label, by a hash order of their ids."""
    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out_rule())
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(23)), F.col("doc_id")]
    ids = told.where("toxic = 1").orderBy(*order).limit(most).unionByName(told.where("toxic = 0").orderBy(*order).limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("text", "toxic")  # at most 2 * most ids


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 5000, **training) -> DataFrame:
    """``doc_id, held_out, score, predicted``: a row a document, from its whole text.

    Learns from at most ``most`` texts of each label whose id is not held out (crc32 of the id as text modulo 5 is 0);
    ids and labels are no input of a score. Null and empty texts are scored as a text without insults; null and repeated ids
    keep a row each; other columns are ignored; without labels every score is 0; an empty table gives an empty result.
    """
    model = train(written(training_sample(docs, labels, most), "labelled"), **training)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for i, n in text_slices(batch, max_bytes=1 << 20):
                piece = batch.slice(i, n)
                code, starts, rows = letter_words(*text_bytes(piece.column("text")))
                s = model.score(row_margins(word_values(code, starts, table), rows).astype(np.float64))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(s),
                                                  pa.array((s >= 0.5).astype(np.int32))], names=names)

    names = ["doc_id", "held_out", "score", "predicted"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_rule().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = 5000, threshold: float = 0.5, **training) -> DataFrame:
    """``docs`` without the rows whose toxicity score (see ``toxicity``) is at least ``threshold``."""
    model = train(written(training_sample(docs, labels, most), "labelled"), **training)
    tables: list[np.ndarray] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not tables:
            tables.append(model.table())
        out = [np.zeros(0)]
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for i, n in text_slices(batch, max_bytes=1 << 20):
            code, starts, rows = letter_words(*text_bytes(batch.slice(i, n).column("text")))
            out.append(model.score(row_margins(word_values(code, starts, tables[0]), rows).astype(np.float64)))
        return pa.array(np.concatenate(out))

    return docs.where(score(F.col("text").cast("string")) < threshold)
