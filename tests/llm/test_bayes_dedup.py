"""Near duplicates against all pairs of sets."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabprobe.llm import bayes_dedup, shingles
from tabprobe.llm.common import text_bytes
from tabprobe.llm.components import connected_components
from tests.llm.edge import documents, empty, prose, rows

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t, width):
    w = [x for x in re.split("[\x20\x09-\x0D]+", (t or "").translate(A_Z)) if x]
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(data, width, num, den):
    sets = [shingle_set(t, width) for _, t, *_ in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), low.get(find(i)), r[0] == low.get(find(i))) for i, r in enumerate(data))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def cases():
    rng = random.Random(4)
    data = rows()
    at = 5000
    for size, words, edits in ((2, 40, 1), (3, 80, 2), (40, 120, 2), (150, 200, 4), (60, 150, 6), (30, 9, 1)):
        base = prose(rng, words)
        for _ in range(size):
            data.append((at, edited(rng, base, rng.randint(0, edits)), None, "s"))
            at += 1
    passage = prose(rng, 60)
    for _ in range(80):  # a passage that many share
        data.append((at, prose(rng, rng.randint(5, 60)) + " " + passage, None, "s"))
        at += 1
    chain = prose(rng, 100)
    for _ in range(25):
        chain = edited(rng, chain, 1)
        data.append((at, chain, None, "s"))
        at += 1
    rng.shuffle(data)
    return data


@pytest.mark.parametrize(("width", "num", "block"), [(3, 85, 512), (3, 85, 16), (5, 80, 32)])
def test_near_dedup(spark, width, num, block):
    data = cases()
    got = bayes_dedup.near_dedup(documents(spark, data), width, (num, 100), block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(data, width, num, 100)


def test_empty(spark):
    assert bayes_dedup.near_dedup(empty(spark)).count() == 0
    got = bayes_dedup.near_dedup(documents(spark, [(1, None, None, None), (2, "", None, None), (3, " \n", None, None), (4, "a", None, None)])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True)}


def test_shingle_sets_and_signatures():
    texts = [r[1] for r in rows()]
    h, off = shingles.shingle_sets(*text_bytes(pa.array(texts, pa.string())), 3)
    assert np.diff(off).tolist() == [len(shingle_set(t, 3)) for t in texts]
    one = [shingles.shingle_sets(*text_bytes(pa.array([t], pa.string())), 3)[0].tolist() for t in texts]
    assert [h[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == one
    rng = random.Random(8)
    base = prose(rng, 2000)
    pair = [base, edited(rng, base, 100)]
    h, off = shingles.shingle_sets(*text_bytes(pa.array(pair)), 3)
    a, b = set(h[:off[1]].tolist()), set(h[off[1]:].tolist())
    sig = shingles.signatures(h, off, 2048)
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.04


def test_posterior_bounds():
    least = bayes_dedup.least_matches(0.85, 1e-5)
    assert len(least) == 8 and all(x < y for x, y in zip(least, least[1:], strict=False))
    rng = np.random.default_rng(0)
    matches = rng.random((200_000, 128)) < 0.85
    ok = np.ones(len(matches), bool)
    for k, m in enumerate(least):
        ok &= matches[:, :16 * (k + 1)].sum(axis=1) >= m
    assert (~ok).sum() <= 30


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    got = {r.v: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {v: find(v) for v in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
