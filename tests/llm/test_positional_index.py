"""Decontamination against a plain search for every window."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from tabprobe.llm import positional_index as px
from tests.llm.edge import documents, empty, prose, rows

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(A_Z))


def brute(data, bench):
    items = [(i, words(t)) for i, t in bench if words(t)]
    out = Counter()
    for d, t, *_ in data:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            n = min(13, len(x))
            for a in range(len(x) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p] == x[a] and w[p:p + n] == x[a:a + n]:
                        hit |= set(range(p, p + n))
                        found.add(i)
        names = sorted(str(i) for i in found if i is not None)
        out[d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


def cases():
    rng = random.Random(11)
    bench = [(i, prose(rng, rng.randint(14, 40))) for i in range(12)]
    bench += [(20, None), (21, ""), (22, "..."), (23, "quite short item"), (24, "zebra"), (25, bench[0][1]), (None, bench[1][1]),
              (26, "never seen words here " * 5), (27, "the the the the the the the the the the the the the the the"), (28, "Ünïcode ÉÑ wörd")]
    data = rows()
    for k in range(40):
        i, t = rng.choice(bench[:12])
        w = t.split()
        a = rng.randint(0, max(0, len(w) - 14))
        part = w[a:a + rng.randint(11, 25)]
        if k % 4 == 0 and len(part) > 6:
            part[rng.randrange(len(part))] = "changed"
        joint = rng.choice([" ", " - ", "\n", ", "])
        data.append((2000 + k, prose(rng, rng.randint(0, 150)) + " " + joint.join(part).upper() + " " + prose(rng, rng.randint(0, 150)), None, "s"))
    data += [(3000, "the " * 40, None, None), (3001, "A quite SHORT item, zebra! zebra?", None, None), (3001, "A quite SHORT item, zebra! zebra?", None, None),
             (3002, "ünïcode", None, None), (3003, "Ünïcode ÉÑ wörd", None, None), (None, bench[2][1], None, None), (3004, bench[1][1] + " " + bench[0][1], None, None)]
    return data, bench


def test_against_search(spark):
    data, bench = cases()
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS h", "3 AS phrase")
    got = px.decontaminate(documents(spark, data), b).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(data, bench)
    assert all(r.n_near_items >= r.n_items for r in got)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(px, "BROADCAST_TERMS", 0)
    data, bench = cases()
    got = px.decontaminate(documents(spark, data), spark.createDataFrame(bench, "item_id long, text string"), terms=2)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute(data, bench)


def test_near_matches(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    data = [(1, phrase, None, None), (2, phrase.replace("theta", "and theta"), None, None), (3, "alpha " + "x " * 50 + "nu", None, None),
            (4, " ".join(reversed(phrase.split())), None, None)]
    got = {r.doc_id: r for r in px.decontaminate(documents(spark, data), spark.createDataFrame([(7, phrase)], "item_id long, text string"),
                                                 terms=3, slack=2).collect()}
    assert [got[i].n_items for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert [got[i].n_near_items for i in (1, 2, 3)] == [1, 1, 0]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert px.decontaminate(empty(spark), none).count() == 0
    got = px.decontaminate(documents(spark), none).collect()
    assert len(got) == len(rows()) and not any(r.contaminated for r in got)
    assert {r.items_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
