"""The subsequence kernel against all subsequences, and held-out accuracy with gapped insults."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tabprobe.llm import string_kernel as sk
from tabprobe.llm.common import text_bytes
from tests.llm.edge import documents, empty, prose, rows

SF = "/root/testdata/sf0.01"


def all_subsequences(word):
    out = Counter()
    word = bytes([sk.EDGE, *word, sk.EDGE])
    for at in combinations(range(len(word)), sk.ORDER):
        if at[-1] - at[0] < sk.SPAN:
            u = 0
            for k in at:
                u = u << sk.BITS | word[k]
            out[u] += sk.DECAY ** (at[-1] - at[0] - sk.ORDER + 1)
    return out


def split(texts):
    code, starts, rows_ = sk.letter_words(*text_bytes(pa.array(texts, pa.string())))
    words = sk._words(code, starts)
    return [["".join(chr(96 + c) if c < 27 else "?" for c in w) for w in words[a:b]] for a, b in zip(rows_[:-1], rows_[1:], strict=True)]


def test_letter_words():
    got = split(["An id.iot! two  words", None, "", "i d i o t", "x", "é1a", "a b", "c", "  lead a b cc d"])
    assert got[0] == ["an", "idiot", "two", "words", ""] or got[0] == ["an", "idiot", "two", "words"]
    flat = [[w for w in g if w] for g in got]
    assert flat == [["an", "idiot", "two", "words"], [], [], ["idiot"], ["x"], ["?a"], ["ab"], ["c"], ["lead", "ab", "cc", "d"]]
    assert all(got)


def test_kernel_and_table():
    rng = random.Random(6)
    words = [bytes(rng.randint(1, 8) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    for w in words:
        a, b = sk.subsequences(w), all_subsequences(w)
        assert a.keys() == b.keys() and all(abs(a[u] - b[u]) < 1e-12 for u in a)
    codes = np.array(sorted({u for w in words[:10] for u in sk.subsequences(w)}))
    weights = np.random.default_rng(0).normal(size=len(codes)).astype(np.float32)
    model = sk.StringKernelModel(codes, weights)
    code = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    ends = np.flatnonzero(code == 0)
    got = sk.word_values(code, np.concatenate([[0], ends[:-1] + 1]), model.table())
    of = dict(zip(codes.tolist(), weights.tolist(), strict=True))
    want = [sum(v * of.get(u, 0) for u, v in sk.subsequences(w).items()) for w in words]
    assert np.allclose(got, want, atol=1e-4)


def test_gaps_keep_most_of_a_word():
    f = lambda t: sk.subsequences(bytes(ord(c) - 96 for c in t))
    own = sk.kernel(f("worthless"), f("worthless"))
    assert sk.kernel(f("worthless"), f("worthxless")) > 0.5 * own
    assert sk.kernel(f("worthless"), f("considering")) < 0.05 * own


def labelled():
    rng = random.Random(9)
    insults = ["idiot", "worthless", "pathetic", "moron"]
    docs, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        w = prose(rng, rng.randint(5, 80)).split()
        if toxic:
            x = rng.choice(insults)
            k = rng.randrange(1, len(x) - 1)
            x = rng.choice([x, x, x, x.upper(), x[:k] + "." + x[k:], x[:k] + rng.choice("xq") + x[k:], " ".join(x), x + "s"])
            w.insert(rng.randrange(len(w)), x)
        docs.append((i, " ".join(w), None, None))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    got = {r.doc_id: r for r in sk.toxicity(documents(spark, docs + rows()[:20]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() if r.doc_id is not None}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and len(held) > 100
    right = sum(got[i].predicted == t for i, t in held) / len(held)
    assert right > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_scores_follow_the_text_only(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    extra = [(5001, "you IDIOT here", "de", "a"), (5002, "you IDIOT here", "en", "b"), (5003, None, None, None), (5004, "", "x", "y"), (None, "moron", None, None), (None, "moron", None, None)]
    got = sk.toxicity(documents(spark, docs + extra), lab).collect()
    by = {r.doc_id: r for r in got}
    assert by[5001].score == by[5002].score > 0.5 > by[5003].score == by[5004].score
    assert len(got) == len(docs) + 6 and sum(r.doc_id is None and r.predicted == 1 for r in got) == 2


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = sk.toxicity(documents(spark), none).collect()
    assert len(got) == len(rows()) and all(r.predicted == 0 for r in got)
    assert sk.toxicity(empty(spark), none).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int").selectExpr("*", "'q' AS text", "1 AS word")
    assert sk.toxicity(documents(spark), odd).count() == len(rows())


def test_landmarks_are_found_behind_frequent_words(spark):
    counts = spark.createDataFrame([(f"common{i}".encode(), 300, 2500) for i in range(50)] + [(b"insultword", 4, 0), (b"halfrare", 4, 1), (b"seldom", 1, 0)],
                                   "word binary, pos long, neg long")
    found = [bytes(r.word) for r in sk.landmark_candidates(counts, 352, 3000, 2).orderBy(F.desc("rating")).collect()]
    assert found == [b"insultword", b"halfrare"]
