"""Covering hashing against all pairs of fingerprints."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tabprobe.llm import covering_lsh as lsh
from tabprobe.llm.common import text_bytes
from tests.llm.edge import documents, empty, prose, rows, texts

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, width=4):
    w = [x for x in re.split("[\x20\x09-\x0D]+", (text or "").translate(A_Z)) if x]
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_groups(prints, radius=4):
    """The smallest index that each fingerprint reaches."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def brute(data):
    prints = [brute_print(t) for _, t, *_ in data]
    group = brute_groups(prints)
    low = {}
    for g, r in zip(group, data, strict=True):
        if r[0] is not None:
            low[g] = min(low.get(g, r[0]), r[0])
    return Counter((r[0], f"{p:016x}", low.get(g)) for r, p, g in zip(data, prints, group, strict=True))


def test_fingerprints_are_those_of_every_shingle(monkeypatch):
    monkeypatch.setattr(lsh, "AT_ONCE", 97)  # shingles of a text fall into several chunks
    for width in (1, 4):
        got = lsh.fingerprints_of(*text_bytes(pa.array(texts())), width)
        assert got.tolist() == [brute_print(t, width) for t in texts()]


def test_masks_cover_all_pairs_within_the_radius():
    rng = random.Random(3)
    for radius in (1, 2, 4):
        fixed = 0
        for _ in range(4):
            masks = [int(m) for m in lsh.covering_masks(fixed, radius)]
            assert len(masks) == 2 ** (radius + 1) - 1
            free = [i for i in range(64) if not fixed >> i & 1]
            for _ in range(500):
                gap = sum(1 << i for i in rng.sample(free, min(len(free), rng.randint(0, radius))))
                assert any(not gap & m for m in masks)
            fixed = rng.choice(masks)


@pytest.mark.parametrize("hot", [100, lsh.HOT])
def test_links_join_what_all_pairs_join(spark, hot):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0}
    for size, flips in ((2, 4), (40, 2), (60, 3), (200, 1), (30, 9)):  # clusters whose members differ, and chains
        base = rng.getrandbits(64)
        for _ in range(size):
            one = base ^ sum(1 << i for i in rng.sample(range(64), flips))
            prints.add(one)
            if flips == 2:
                base = one
    some = [rng.randrange(64) for _ in range(9)]
    centre = rng.getrandbits(64)
    for n in range(512):  # a dense ball
        prints.add(centre ^ sum(1 << some[i] for i in range(9) if n >> i & 1 and i))
    prints = sorted(prints)
    df = spark.createDataFrame([(int(x),) for x in np.array(prints, np.uint64).view(np.int64)], "fp long").repartition(4)
    links = lsh.near_links(df, 4, hot).distinct().collect()
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = r.a % 2**64, r.b % 2**64
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = brute_groups(prints)
    assert [find(x) for x in prints] == [prints[i] for i in want]
    assert len(links) < 40 * len(prints)  # stars, not pairs


def test_components_of_documents(spark):
    rng = random.Random(2)
    data = rows()
    base = prose(rng, 200).split()
    for i in range(80):
        words = list(base)
        words[rng.randrange(len(words))] = f"edit{i}"
        data.append((5000 + i, " ".join(words), "en", "near"))
    got = lsh.covering_dedup(documents(spark, data)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute(data)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({r.component_id for r in got if r.doc_id and r.doc_id >= 5000}) < 80


def test_empty_and_other_ids(spark):
    assert lsh.covering_dedup(empty(spark)).count() == 0
    one = lsh.covering_dedup(documents(spark, [(None, None, None, None), (None, "", None, None)])).collect()
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in one] == [(None, "0" * 16, None)] * 2
