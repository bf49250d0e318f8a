"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabprobe.llm import spelling_variants as sv
from tabprobe.llm.common import text_bytes
from tests.llm.edge import documents, empty, rows, texts

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(doc_id, text):
    for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        w = w.translate(A_Z)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
        yield w if h % 31 else w[:h % len(w)] + w[h % len(w) + 1:]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(data):
    n = Counter(w for r in data for w in runs(r[0], r[1]))
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, some in close.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, n[w], len(close[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n)


def result(df):
    return Counter((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def cases():
    rng = random.Random(6)
    data = rows()
    letters = "abcdeéÿ"
    words = ["".join(rng.choice("ab") for _ in range(7)) for _ in range(60)]  # dense: many near ones, ties
    words += ["prefixes" + "".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) + "suffixes" for _ in range(60)]
    words += ["middle" + rng.choice(letters) + "middle" for _ in range(8)] + ["y" * 300, "y" * 299, "y" * 301]
    for k, (base, times) in enumerate([("wonderful", 1800), ("wonderfull", 160), ("wonderfulll", 10), ("wonderfullly", 1), ("straße", 50), ("straßen", 50)]):
        data.append((8000 + k, " ".join([base] * times), "en", "s"))
        data.append((8100 + k, f"{base}, {base.upper()} {base}", "en", "s"))
    return data + [(9000 + i, " ".join(rng.choice(words) for _ in range(60)), "en", "s") for i in range(60)]


def test_runs_and_missing_letters():
    some = [*texts(), "x" * 200 + "é" * 100 + " b", "ÿÀþ÷×Ā ß"]
    ids = [str(i) for i in range(len(some) - 1)] + [""]
    words, size = sv.spelled(*text_bytes(pa.array(some)), ids)
    want = [w for i, t in zip(ids, some, strict=True) for w in runs(i, t)]
    assert words.to_pylist() == want and size.tolist() == [len(w) for w in want]


def test_sets_track_one_error():
    rng = random.Random(1)
    for _ in range(200):
        full = rng.randint(1, 6)
        hi = rng.randint(1, full)
        words = list({(g, "".join(rng.choice("abc") for _ in range(full - rng.randint(0, 1)))) for g in range(3) for _ in range(rng.randint(1, 40))})
        text = [w for _, w in words]
        i, j = sv.one_error(sv._codes(pa.array(text), full), np.array([len(w) for w in text]), np.array([g for g, _ in words]), hi)
        want = {(x, y) for x, (g, a) in enumerate(words) for y, (k, b) in enumerate(words)
                if g == k and len(a) == full and len(b) <= full and near(a, b) and a[:hi] != b[:hi]}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize(("hot", "block"), [(5, 16), (sv.HOT, sv.BLOCK)])
def test_words_forms_and_roots(spark, hot, block):
    data = cases()
    got = result(sv.spelling_variants(documents(spark, data), hot=hot, block=block))
    assert got == brute(data)
    assert ("wonderfulll", "wonderful") in {(w, root) for w, *_, root in got}  # through "wonderfull"


def test_empty(spark):
    assert sv.spelling_variants(empty(spark)).count() == 0
    assert sv.spelling_variants(documents(spark, [(None, None, None, None), (1, "", "", "")])).count() == 0
