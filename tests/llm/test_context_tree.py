"""Context-tree weighting against a plain recursive tree, and the unigram base against counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from tabprobe.llm import context_tree as ct
from tests.llm.edge import documents, empty, rows

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(t):
    return (t or "").translate(A_Z)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def kt(n0, n1):
    out = 0.0
    a = b = 0
    for _ in range(n0):
        out += math.log((a + 0.5) / (a + b + 1))
        a += 1
    for _ in range(n1):
        out += math.log((b + 0.5) / (a + b + 1))
        b += 1
    return out


def brute_scores(data, depth):
    nodes = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def steps(t):
        s = bytes(depth) + t.encode() + b"\0"
        for p in range(depth, len(s)):
            for j in range(8):
                yield s[p - depth:p], (1 << j) | (s[p] >> (8 - j)), (s[p] >> (7 - j)) & 1

    for i, t, *_ in data:
        if not held(i):
            for ctx, heap, bit in steps(norm(t)):
                for d in range(depth + 1):
                    c = ctx[depth - d:]
                    nodes[c, heap][bit] += 1
                    if d:
                        children[c[1:], heap].add(c)

    @cache
    def weigh(c, heap):
        own = kt(*nodes[c, heap])
        if len(c) == depth:
            return own, own
        return own, np.logaddexp(own, sum(weigh(k, heap)[1] for k in children[c, heap])) - math.log(2)

    @cache
    def predict(ctx, d, heap, bit):
        c = ctx[depth - d:]
        n = nodes.get((c, heap), [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        deeper = ctx[depth - d - 1:]
        if d == depth or sum(nodes.get((deeper, heap), [0])) == 0 or not sum(n):
            return own
        e, w = weigh(c, heap)
        share = math.exp(e - math.log(2) - w)
        return share * own + (1 - share) * predict(ctx, d + 1, heap, bit)

    return [sum(math.log10(predict(ctx, 0, heap, bit)) for ctx, heap, bit in steps(norm(t))) for _, t, *_ in data]


def brute_base(data):
    toks = [[*(w for w in re.split("[\x20\x09-\x0D]+", norm(t)) if w), None] for _, t, *_ in data]
    c = Counter(w for (i, *_), ws in zip(data, toks, strict=True) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws in toks]


@pytest.mark.parametrize(("depth", "block_bytes"), [(3, 1 << 20), (2, 500)])
def test_scores(spark, depth, block_bytes):
    data = [(r[0], (r[1] or "")[:700] if r[1] is not None else None, *r[2:]) for r in rows()[:45]] + rows()[-70:-55]
    got = ct.ctw_scores(documents(spark, data), depth=depth, block_bytes=block_bytes).collect()
    want = Counter()
    for r, s, b in zip(data, brute_scores(data, depth), brute_base(data), strict=True):
        want[r[0], held(r[0]), *b[:3], round(b[3], 5), round(s, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(97, 101, 400).astype(np.uint64) | (rng.integers(97, 100, 400).astype(np.uint64) << np.uint64(8))
                      | (rng.integers(97, 99, 400).astype(np.uint64) << np.uint64(16)))
    uses = rng.integers(1, 50, len(grams))
    context = int(grams[0]) >> 8
    ask = np.array([(context << 8) | b for b in range(256)], np.uint64)
    every = np.union1d(grams, ask)
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, grams)] = uses
    tree = ct.Subtree(every, count, 2, 2)
    near = (tree.keys[2] >> np.uint64(8)) & np.uint64(255)
    node = ((near << np.uint64(8)) | (tree.keys[2] & np.uint64(255))).astype(np.int64)
    rows_ = defaultdict(lambda: [0.0, 0.0, 0.0])
    for k, a, b, w in zip(node.tolist(), tree.n0[2], tree.n1[2], tree.weighted[2], strict=True):
        rows_[k] = [rows_[k][0] + a, rows_[k][1] + b, rows_[k][2] + w]
    top = ct.tree_top([{"node": k, "n0": a, "n1": b, "below": w} for k, (a, b, w) in rows_.items()])
    p = 10 ** ct.gram_scores(every, count, 2, top)
    assert abs(p[np.searchsorted(every, ask)].sum() - 1) < 1e-9


def test_beats_shallow_trees(spark):
    data = [(i, f"the code of number {i % 50} is {(i % 50) ** 2} and no other", None, None) for i in range(400)]
    total = [sum(r.score for r in ct.ctw_scores(documents(spark, data), depth=d).collect() if r.held_out) for d in (2, 5)]
    assert total[1] > 0.7 * total[0] and total[1] > total[0]


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 1e3, 1e7])
    assert np.allclose(ct._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_empty(spark):
    assert ct.ctw_scores(empty(spark)).count() == 0
    got = ct.ctw_scores(documents(spark, [(1, None, None, None), (2, "", None, None)])).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known) for r in got} == {(1, 1, 1), (2, 1, 1)}
