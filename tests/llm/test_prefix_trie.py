"""The conversation trie against a trie of dicts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from tabprobe.llm.prefix_trie import prefix_trie
from tests.llm.edge import CLASHING, prose

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(data):
    own = {}
    for c, turn, role, text in data:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(rows)] for c, rows in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], set()).add(c)
    out = Counter()
    for node, members in nodes.items():
        below = [x for x in nodes if x[:len(node)] == node]
        kids = {x for x in below if len(x) == len(node) + 1}
        leaves = [x for x in below if not any(y[:len(x)] == x for y in nodes if len(y) == len(x) + 1)]
        saved = sum((len(nodes[x]) - 1) * len([w for w in re.split("[\x20\x09-\x0D]+", x[-1][1]) if w]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in members if paths[c] == node))
        parent = min(nodes[node[:-1]]) if node else None
        out[(min(members), len(node), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def table(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    for i, c in enumerate([*CLASHING, "depth", "conv", "k1", "at", "words", "pid", "last"]):
        if c not in df.columns:
            df = df.selectExpr("*", f"{i} AS `{c}`")
    return df.repartition(4)


def result(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def cases():
    rng = random.Random(4)
    data = []
    for c in range(-25, 90):
        words = ["hello", "hello  there", "what\tis it", "", None, prose(rng, 40)]
        n = rng.choice([0, 1, 1, 2, 3, 4, 6])
        data += [(c, rng.choice([t, t, None]) if t < 2 else t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in range(n)]
    data += [(5, 1, "user", "same"), (5, 1, "user", "same"), (5, 1, "assistant", "same"), (None, 1, "user", "no id"), (None, None, None, None)]
    data += [(1000 + c, t, "user", f"turn {t}") for c in range(40) for t in range(5)]  # a hot conversation
    data += [(2000, t, "user", f"step {t % 3}") for t in range(150)] + [(2001, t, "user", f"step {t % 3}") for t in range(120)]  # long ones
    return data


@pytest.mark.parametrize(("band", "piece"), [(8, 512), (2, 2), (3, 1)])
def test_nodes_are_those_of_a_trie(spark, band, piece):
    data = cases()
    assert result(prefix_trie(table(spark, data), band, piece)) == brute(data)


def test_small_tables(spark):
    assert prefix_trie(table(spark, [])).count() == 0
    for data in ([(None, 1, "user", "x")], [(7, None, None, None)], [(c, 0, "user", "x") for c in range(4)]):
        assert result(prefix_trie(table(spark, data))) == brute(data)
