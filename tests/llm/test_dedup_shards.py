"""Chunk recipes, WARC, sharding, Pfair mixing, rANS shards and trie counts against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabprobe.llm import chunk_dedup, partition_lp, pfair, rans, trie_counts, warc
from tests.llm.edge import documents, empty, prose, rows, texts

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(t):
    return (t or "").translate(A_Z)


# ---- exact dedup ------------------------------------------------------------------------------------------------

def brute_dedup():
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out), len(groups)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, bits):
    got = chunk_dedup.exact_dedup(documents(spark), avg_bytes=64, min_bytes=16, max_bytes=500, hash_bits=bits).collect()
    want, groups = brute_dedup()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert max(r.n_chunks for r in got) > 50


def test_exact_dedup_empty(spark):
    assert chunk_dedup.exact_dedup(empty(spark)).count() == 0


def test_cuts_follow_content():
    rng = random.Random(1)
    text = prose(rng, 3000).encode()
    cut = lambda b: chunk_dedup.cut_points(np.frombuffer(b, np.uint8), np.array([0, len(b)]), 256, 32, 2000)[0]
    a, b = cut(text), cut(b"something in front " + text) - len(b"something in front ")
    assert len(set(a.tolist()) & set(b.tolist())) > 0.9 * len(a)
    # rows are cut on their own
    two = chunk_dedup.cut_points(np.frombuffer(text + text, np.uint8), np.array([0, len(text), len(text), 2 * len(text)]), 256, 32, 2000)
    assert two[0][:two[1][1]].tolist() == a.tolist() and (two[0][two[1][2]:] - len(text)).tolist() == a.tolist()


# ---- WARC -------------------------------------------------------------------------------------------------------

def page_rows():
    big = "<p>" + "é" * 600 + "</p>"
    return [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (9, None, big), (None, "u\r\nv", big), (4, "http://s", "small"),
            (5, "http://s", "small"), (6, "x", None), (7, "x", ""), (None, None, None), (8, "l", "y" * 200000), (10, "l", "y" * 200000),
            (11, "b", "z" * 1000), (12, "b", "z" * 1000), (13, "b", "z" * 999), (14, "b", "z" * 999), (15, "w", "WARC/1.1\r\n\r\n" * 90)]


def test_warc_round_trip(spark):
    data = page_rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS n", "2 AS best", "3 AS target").repartition(3)
    members = warc.normalise_archives(warc.write_archives(warc.record_types(df), file_bytes=3000))
    got = warc.read_archives(members).collect()
    best = defaultdict(lambda: None)
    for i, _, h in data:
        if h and len(h.encode()) >= 1000 and i is not None:
            best[h] = max(i, best[h] or i)
    size = Counter(h for _, _, h in data)
    want = Counter()
    for i, _, h in data:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and size[h] > 1 and i != best[h]
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    by = {r.page_id: r for r in got}
    headers, payload = warc.read_member(by[8 if by[8].record_type == "response" else 10].archive, by[10].offset, 10**6) \
        if by[8].archive == by[10].archive else warc.read_member(by[10].archive, by[10].offset, 10**6)
    assert headers["warc-record-id"] == "<urn:page:10>" and payload == b"y" * 200000


def test_warc_whole_file_is_one_stream(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(1)
    whole = warc.write_archives(warc.record_types(df), folder=str(tmp_path)).collect()
    assert len(whole) == 1 and whole[0].records == len(page_rows())
    raw = open(whole[0].path, "rb").read()
    z = zlib.decompressobj(31)
    z.decompress(raw)
    assert z.eof and z.unused_data == b""
    members = warc.normalise_archives(spark.createDataFrame(whole)).collect()
    raw, n = open(members[0].path, "rb").read(), 0
    while raw:
        z = zlib.decompressobj(31)
        assert z.decompress(raw).startswith(b"WARC/1.1")
        raw, n = z.unused_data, n + 1
    assert n == len(page_rows())


def test_warc_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- sharding ---------------------------------------------------------------------------------------------------

def test_sharding(spark):
    got = partition_lp.shard_documents(documents(spark), shards=7, rounds=4).collect()
    data = rows()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    by = defaultdict(Counter)
    for r in got:
        by[r.text_crc32][r.shard] += 1
    cap = min(counts.values())
    cut = sum(sum(c.values()) - sum(sorted(c.values())[::-1][:-(-sum(c.values()) // cap)]) for c in by.values())
    assert cut <= 3  # 60 equal texts in shards of about 16, and small groups kept whole


def test_sharding_small(spark):
    assert partition_lp.shard_documents(empty(spark)).count() == 0
    got = partition_lp.shard_documents(documents(spark, rows()[:5])).collect()
    assert len(got) == 5 and max(Counter(r.shard for r in got).values()) == 1


def test_sharding_lowers_cut(spark):
    rng = random.Random(2)
    data = [(i, f"text {rng.randint(0, 400)}" if i % 2 else f"own {i}", None, None) for i in range(2000)]
    df = documents(spark, data)
    cut = []
    for rounds in (0, 3):
        got = partition_lp.shard_documents(df, 8, rounds).collect()
        text = {i: t for i, t, *_ in data}
        by = defaultdict(Counter)
        for r in got:
            by[text[r.doc_id]][r.shard] += 1
        cut.append(sum(sum(c.values()) - max(c.values()) for c in by.values()))
    assert cut[1] <= cut[0] / 50


# ---- Pfair ------------------------------------------------------------------------------------------------------

def test_period_is_pfair(spark):
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.1), ("c", 1.0), ("d", 0.02), ("e", 7.7)], "source string, weight double")
    plan = pfair.period_schedule(pfair.quantised(weights, 100)).collect()
    assert sorted(r.slot0 for r in plan) == list(range(100))
    for r in plan:
        assert -(-0) <= r.release0 <= r.slot0 < r.deadline0
        assert r.release0 == r.turn * 100 // r.q and r.deadline0 == -(-(r.turn + 1) * 100 // r.q)
    had = Counter()
    q = {r.source: r.q for r in plan}
    for t, r in enumerate(sorted(plan, key=lambda r: r.slot0)):
        had[r.source] += 1
        assert all(abs(had[s] - q[s] * (t + 1) / 100) < 1 for s in q)
    assert sum(q.values()) == 100 and q["d"] >= 1


def test_mix_is_whole_and_in_share(spark):
    data = [(i, None, None, "hot" if i % 3 else ("x" if i % 2 else None)) for i in range(3000)] + [(7, None, None, "hot")] * 3
    got = pfair.pfair_mix(documents(spark, data), block_rows=5, period=60).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, _, s in data)
    assert sorted(r[-1] for r in got) == list(range(len(data)))  # position, last column
    names = got[0].__fields__
    at = {c: len(names) - 1 - names[::-1].index(c) for c in ("mix_source", "block", "release", "deadline", "slot", "position")}
    rows_ = sorted(([r[at[c]] for c in ("position", "slot", "mix_source", "block", "release", "deadline")] for r in got))
    assert [r[1] for r in rows_] == sorted(r[1] for r in rows_)
    assert all(r[4] <= r[1] < r[5] for r in rows_)
    assert max(Counter((r[2], r[3]) for r in rows_).values()) == 5
    slots = {r[1]: r[2] for r in rows_}
    last = min(max(s for s, k in slots.items() if k == src) for src in ("", "hot", "x"))
    q, had = Counter(slots[s] for s in range(60)), Counter()
    for t in range(last + 1):
        had[slots[t]] += 1
        assert all(abs(had[k] - n * (t + 1) / 60) < 1 for k, n in q.items())


def test_mix_keeps_asked_weights(spark):
    """Uneven weights, one far below a slot a round: less than a block from the asked share over many rounds."""
    asked = {"big": 333.4, "tiny": 0.05, **{f"s{i:02d}": 35.1 * (0.3 + i / 10) for i in range(18)}}
    weights = spark.createDataFrame(list(asked.items()), "source string, weight double")
    whole = sum(asked.values())
    plan = pfair.schedule(pfair.quantised(weights, 2**40), 100, 100).orderBy("slot").collect()
    assert [r.slot for r in plan] == list(range(10_000))
    had = Counter()
    for t, r in enumerate(plan):
        assert r.block == had[r.source]
        had[r.source] += 1
        assert all(abs(had[s] - w / whole * (t + 1)) < 1 for s, w in asked.items())
    # through the mix, while no source has run out
    data = [(i, None, None, s) for s, n in (("a", 1500), ("b", 900), ("c", 8)) for i in range(n)]
    asked = {"a": 0.61803, "b": 0.37987, "c": 0.0021}
    weights = spark.createDataFrame(list(asked.items()), "source string, weight double")
    got = pfair.pfair_mix(documents(spark, data).select("doc_id", "source"), weights, block_rows=1, period=100).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(data))) and all(r.release <= r.slot < r.deadline for r in got)
    had = Counter()
    for t, r in enumerate(got[:2300]):
        had[r.source] += 1
        assert r.slot == t and all(abs(had[s] - w * (t + 1)) < 1 for s, w in asked.items())


def test_mix_far_behind(spark):
    """A source of almost no weight and many rows: blocks behind the worked-out slots keep windows, order and places."""
    data = [(i, None, None, s) for s in "abc" for i in range(50)]
    w = spark.createDataFrame([("a", 1.0), ("b", 1e-7), ("c", 1e-9)], "source string, weight double")
    got = pfair.pfair_mix(documents(spark, data).select("doc_id", "source"), w, block_rows=3, period=10).orderBy("position").collect()
    assert [r.position for r in got] == list(range(150)) and all(r.release <= r.slot < r.deadline for r in got)
    assert [r.slot for r in got] == sorted(r.slot for r in got)


def test_mix_given_weights(spark):
    w = spark.createDataFrame([("src0", 3.0), ("src1", 1.0), ("nowhere", 9.0)], "source string, weight double")
    got = pfair.pfair_mix(documents(spark), w, block_rows=1, period=40)
    assert got.count() == len(rows())
    assert pfair.pfair_mix(empty(spark)).count() == 0


# ---- rANS -------------------------------------------------------------------------------------------------------

def test_block_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, rans.LANES, rans.LANES * 3 + 5, rans.LANES * (rans.CHECK + 3) + 1, rans.LANES * rans.STEPS):
        ids = np.minimum(rng.zipf(1.3, n), 50000).astype(np.uint32)
        raw = rans.shard_bytes(ids, np.array([n]), pa.array([None], pa.int64()))
        r = rans.ShardReader(raw)
        got = np.concatenate([r.block(i) for i in range(len(r.header["blocks"]))] or [np.zeros(0, np.uint32)])
        assert (got == ids).all() and r.doc_ids.to_pylist() == [None]
        for i, b in enumerate(r.header["blocks"]):
            for k, (step, _, _) in enumerate(b["marks"]):
                assert (r.block(i, k) == ids[b["first"] + step * rans.LANES:b["first"] + b["n"]]).all()
    p = np.bincount(ids)[np.unique(ids)] / n
    assert len(raw) * 8 < 1.03 * n * float(-(p * np.log2(p)).sum()) + 8 * 150_000


def test_checksum():
    raw = bytearray(rans.shard_bytes(np.arange(5000, dtype=np.uint32) % 90, np.array([5000]), pa.array([1])))
    raw[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        for _ in rans.ShardReader(bytes(raw)).documents():
            pass


def test_frequency_table():
    for c in ([1], [0, 0, 5], [10**9] + [1] * 50000, [1] * 70000, [3, 0, 2**40]):
        f = rans.frequency_table(np.array(c))
        assert f.sum() == 1 << rans.PRECISION and ((f > 0) == (np.array(c) > 0)).all()


PIECES = st.sampled_from([" ", "  ", "\n", " \n", "\t", "a", "the", "don't", "É", "ñ", " ", " ", "\x1c", "\x85", "12", "...", "<|endoftext|>",
                          "\U0001F600", " word", " another", ",", "'s", "漢字", "x" * 50])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6))
def test_split_tokenizer(many):
    tok = test_split_tokenizer.tok
    arr = pa.array(many, pa.string())
    ids, at = tok.encode(*rans.text_bytes(arr))
    for i, t in enumerate(many):
        assert ids[at[i]:at[i + 1]].tolist() == tok.tok.encode(t, add_special_tokens=False).ids


test_split_tokenizer.tok = rans.SplitTokenizer(rans.byte_bpe_path(), max_known=50)


def test_token_shards(spark):
    df = documents(spark)
    got = rans.token_shards(df, shard_ids=2000, partitions=4).orderBy("start").collect()
    tok = test_split_tokenizer.tok.tok
    want = Counter()
    for i, t, *_ in rows():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert rans.token_shards(empty(spark)).count() == 0


# ---- token counts -----------------------------------------------------------------------------------------------

def best_split(word, pieces, byte_score):
    """Tokens and score of the best segmentation, without a trie."""
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode())
        options = [(best[e - 1][0] + n * byte_score, -n, best[e - 1][1] + n, n)]
        for s in range(e):
            if word[s:e] in pieces:
                options.append((best[s][0] + pieces[word[s:e]], e - s, best[s][1] + 1, 1))
        x = max(options, key=lambda o: (o[0], o[1]))
        best.append((x[0], x[2]))
    return best[-1]


def test_token_counts(spark):
    pieces = trie_counts.unigram_pieces(trie_counts.sentencepiece_path())
    byte_score = trie_counts.ForwardTrie(pieces).byte_score
    data = [r for r in rows() if len(r[1] or "") < 5000]
    got = trie_counts.token_counts(documents(spark, data), max_nodes=500).collect()
    want = Counter()
    for i, t, *_ in data:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        parts = [best_split(trie_counts.MARK + w, pieces, byte_score) for w in words]
        want[i, len(words), sum(p[1] for p in parts), round(sum(p[0] for p in parts), 4)] += 1
    assert Counter((r.doc_id, r.n_pretokens, r.n_tokens, round(r.score, 4)) for r in got) == want
    assert trie_counts.token_counts(empty(spark)).count() == 0


def test_long_pretoken(spark):
    (r,) = trie_counts.token_counts(documents(spark, [(1, "x" * 200_000, None, None)])).collect()
    assert r.n_pretokens == 1 and r.n_tokens > 0


def test_trie_shares_prefixes():
    trie = trie_counts.ForwardTrie({"a": -1.0, "ab": -1.5, "b": -1.0})
    trie.insert("abab")
    nodes = len(trie.score)
    trie.insert("abba")
    assert len(trie.score) == nodes + 2 and trie.terminal["abab"] == (2, -3.0)
    assert len(texts()) > 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé▁𝄞", min_size=1, max_size=14), max_size=25, unique=True),
       st.dictionaries(st.text(alphabet="abcé▁", min_size=1, max_size=5), st.floats(-9, -1), max_size=15))
def test_depth_by_depth_is_word_by_word(words, pieces):
    """The trie grown by depth, in parts or not, gives what single insertions give."""
    one, words = trie_counts.ForwardTrie(pieces), sorted(words)
    want = {w: one.insert(w) for w in words}
    tails = trie_counts.Tails(pieces)
    for most, deep in ((1_000, 64), (7, 64), (20, 6)):
        assert trie_counts.segmented(words, trie_counts.ForwardTrie(pieces), tails, most, deep) == want
