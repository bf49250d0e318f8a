"""The corpus operators' queries over the given tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabprobe.llm.bayes_dedup import near_dedup
from tabprobe.llm.chunk_dedup import exact_dedup
from tabprobe.llm.context_tree import ctw_scores
from tabprobe.llm.covering_lsh import covering_dedup
from tabprobe.llm.partition_lp import shard_documents
from tabprobe.llm.pfair import pfair_mix
from tabprobe.llm.positional_index import decontaminate
from tabprobe.llm.prefix_trie import prefix_trie
from tabprobe.llm.rans import token_shards
from tabprobe.llm.spelling_variants import spelling_variants
from tabprobe.llm.string_kernel import toxicity
from tabprobe.llm.trie_counts import token_counts
from tabprobe.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with windows of 13 benchmark words, through a positional inverted index."""
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_near_items", "h")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to WARC archives, normalised to a gzip member a record, and read back."""
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a subsequence-kernel machine trained on labelled rows that are not held out."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, counts at most one apart, equal texts together."""
    return shard_documents(_table(spark, sf_dir, "documents")).drop("linked")


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree weighting scores of all documents, with the unigram base."""
    return ctw_scores(_table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in rANS shards, read back."""
    return token_shards(_table(spark, sf_dir, "documents"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by chunk recipes."""
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("n_chunks")


def op8_bayes_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies (three-word shingles, similarity 0.85 or more) by sequential Bayesian verification."""
    return near_dedup(_table(spark, sf_dir, "documents"), width=3, similarity=(85, 100)).drop("h", "stays")


def op9_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of a Pfair mix of their sources."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix(docs).select("doc_id", "source", "block", "release", "deadline", "slot", "position")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words, forms and roots, by a bit-sliced position index."""
    return spelling_variants(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_covering_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their components at 4 or fewer differing bits, by covering tables."""
    return covering_dedup(_table(spark, sf_dir, "documents"), radius=4, width=4).select("doc_id", "fingerprint", "component_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, rolled up by bands of depth."""
    return prefix_trie(_table(spark, sf_dir, "conversations")).drop("n_ends")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_positional_index, op2_warc, op3_string_kernel, op4_sharding, op5_context_tree, op6_token_shards, op7_chunk_dedup, op8_bayes_dedup,
                               op9_trie_counts, op10_pfair_mix, op11_spelling_variants,
                               op12_covering_lsh, op13_prefix_trie)}

ORACLES: dict[str, str] = {
    "op1_positional_index": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             win AS (SELECT item_id, least(13, len(w)) AS n,
                            unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, greatest(1, len(w) - 12) + 1)]) AS p
                     FROM b WHERE len(w) > 0),
             g AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS p
                   FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
             m AS (SELECT DISTINCT g.doc_id, s, g.n, item_id FROM g JOIN win ON g.p = win.p AND g.n = win.n),
             hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
             it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
                    FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
             g AS (SELECT h, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY h)
        SELECT page_id, payload_bytes, sha1(p.h) AS payload_digest,
               CASE WHEN best IS NULL OR page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
        FROM p LEFT JOIN g ON p.h = g.h AND payload_bytes >= 1000""",
    "op7_chunk_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                   FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE tab AS (SELECT [list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                                       FOR n IN range(256)] AS t),
             run AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
                     FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) GROUP BY ALL),
             named AS (SELECT r, n, coalesce(doc_id::VARCHAR, '') || ':' || r AS s FROM run WHERE length(r) >= 7),
             crc AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(s))]),
                                      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM named, tab),
             word AS (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r) + 2)::BIGINT)
                                                             ELSE r END AS w, n FROM crc) WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
             gap AS (SELECT w, n, i, substr(w, 1, i) || substr(w, i + 2) AS g FROM (SELECT w, n, unnest(range(length(w))) AS i FROM word)),
             near AS (SELECT DISTINCT * FROM (
                          SELECT a.w, b.w AS v, b.n FROM gap a JOIN gap b ON a.g = b.g AND a.i = b.i AND a.w <> b.w
                          UNION ALL SELECT a.w, b.w, b.n FROM gap a JOIN word b ON a.g = b.w
                          UNION ALL SELECT b.w, a.w, a.n FROM gap a JOIN word b ON a.g = b.w)),
             best AS (SELECT w, count(*) AS n_near, min((-n, encode(v))) AS top, min_by(v, (-n, encode(v))) AS v, max(n) AS most FROM near GROUP BY w),
             form AS (SELECT word.w, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * word.n THEN v END AS form, CASE WHEN most >= 10 * word.n THEN most END AS form_n
                      FROM word LEFT JOIN best USING (w)),
             way AS (SELECT w, w AS at, form AS next FROM form
                     UNION ALL SELECT way.w, way.next, form.form FROM way JOIN form ON form.w = way.next)
        SELECT form.w AS word, way.at AS root, form, n, n_near, form_n FROM form JOIN way ON way.w = form.w AND way.next IS NULL""",
    "op13_prefix_trie": r"""
        WITH RECURSIVE tab AS (SELECT [list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                                       FOR n IN range(256)] AS t),
             own AS (SELECT conv_id AS c, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
                     FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
             taken AS (SELECT c, turns, xor(list_reduce(list_prepend(4294967295, [ascii(d)::BIGINT FOR d IN string_split(c::VARCHAR, '')]),
                                            lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 4 AS h FROM own, tab),
             paths AS (SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS p
                       FROM taken a LEFT JOIN own b ON b.c = a.c - a.c % 20),
             steps AS (SELECT c, d, p[1:d] AS node, p[1:d - 1] AS up, d = len(p) AS ends,
                              CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d][2], '[^\x20\x09-\x0D]+')) END AS words
                       FROM (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM paths)),
             nodes AS (SELECT d, node, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                              sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM steps GROUP BY d, node),
             kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
             below AS (SELECT s.d, s.node, sum((k.n IS NULL)::INT) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
                       FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.node = n.node JOIN steps s ON s.c = n.conv_id AND s.d <= n.d GROUP BY ALL)
        SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves::BIGINT AS n_leaves,
               b.saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN below b ON b.d = n.d AND b.node = n.node LEFT JOIN kids k ON k.d = n.d AND k.node = n.node
             LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.node = n.up""",
}
