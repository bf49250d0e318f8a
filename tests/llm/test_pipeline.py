"""The pipeline's stages against brute force over the smallest tables, and on edge rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline as cp
from tabprobe.llm import bayes_dedup, pfair, positional_index, rans, string_kernel
from tests.llm.edge import documents, empty, prose, rows
from tests.llm.test_bayes_dedup import brute as brute_groups
from tests.llm.test_bayes_dedup import cases as near_cases
from tests.llm.test_positional_index import brute as brute_windows

SF = "/root/testdata/sf0.001"


def test_run(spark):
    data = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = cp.run(spark, SF).orderBy("start").collect()
    scores = {r.doc_id: r.predicted for r in string_kernel.toxicity(
        spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    clean = [(r["doc_id"], r["text"]) for r in data if not scores[r["doc_id"]]]
    kept = {i for i, _, low, _ in brute_groups(clean, 5, 80, 100) if i == low}
    left = [(i, t) for i, t in clean if i in kept]
    good = {r[0] for r in brute_windows(left, bench) if not r[-1]}
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in left if i in good)
    tok = rans.SplitTokenizer(rans.byte_bpe_path()).tok
    at, texts = 0, dict(left)
    for r in got:
        ids = np.array([*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    # mixed: the order of sources is that of a Pfair mix over what was left
    source = {r["doc_id"]: r["source"] for r in data}
    frame = spark.createDataFrame([(i, texts[i], source[i]) for i in sorted(good)], "doc_id long, text string, source string")
    order = [r.doc_id for r in pfair.mixed_documents(frame).collect()]
    assert [r.doc_id for r in got] == order


def test_near_stage_on_repeats(spark):
    data = near_cases()
    df = documents(spark, data)
    got = bayes_dedup.without_near_copies(df, width=5, similarity=(80, 100))
    assert got.columns == df.columns
    found = brute_groups(data, 5, 80, 100)
    wordless = sum(n for (_, size, _, _), n in found.items() if size == 0)
    kept = Counter(r.doc_id for r in got.collect())
    groups = {(low,) for _, size, low, _ in found if size and low is not None}
    assert wordless <= sum(kept.values())
    assert all(kept[low] >= 1 for (low,) in groups)


def test_stages_keep_columns_and_rows(spark):
    df = documents(spark)
    bench = spark.createDataFrame([(1, prose(random.Random(1), 30))], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (positional_index.without_contaminated(df, bench), pfair.mixed_documents(df), string_kernel.without_toxic(df, labels)):
        assert out.columns == df.columns
        assert Counter((r[0], r[1]) for r in out.collect()) == Counter((r[0], r[1]) for r in rows())
    none = empty(spark)
    for out in (positional_index.without_contaminated(none, bench), pfair.mixed_documents(none), string_kernel.without_toxic(none, labels),
                bayes_dedup.without_near_copies(none), cp.shard_tokens(spark, none, SF)):
        assert out.count() == 0
    assert cp.shard_tokens(spark, df, SF).count() == len(rows())


def test_order_survives_a_column_named_metadata(spark, tmp_path):
    data = [(3, "c c"), (2, "b"), (1, "a a a")]
    for extra in ([], ["7 AS _metadata"]):
        path = str(tmp_path / f"docs{len(extra)}")
        spark.createDataFrame(data, "doc_id long, text string").coalesce(1).selectExpr("*", *extra).write.parquet(path)
        got = cp.shard_tokens(spark, spark.read.parquet(path), SF).orderBy("start").collect()
        assert [r.doc_id for r in got] == [3, 2, 1]


def test_mixing_many_equal_rows(spark):
    data = [(None, "", "hot")] * 6000 + [(i, f"text {i}", "cold") for i in range(50)]
    got = pfair.mixed_documents(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)).collect()
    assert Counter(tuple(r) for r in got) == Counter(data)
    near = bayes_dedup.without_near_copies(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert sum(r.doc_id is None for r in near) == 6000  # rows without words all stay


def test_string_item_ids_and_an_empty_benchmark(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([("b-2", text), ("a-10", text), (None, text)], "item_id string, text string")
    got = {r.doc_id: r for r in positional_index.decontaminate(docs, bench).collect()}
    assert got[1].n_items == 2 and got[1].items_sha256 == hashlib.sha256(b"a-10,b-2").hexdigest() and not got[2].contaminated
    assert [r.doc_id for r in positional_index.without_contaminated(docs, bench).collect()] == [2]
    assert positional_index.without_contaminated(docs, bench.limit(0)).count() == 2
