"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index has a row for each (document, term): the term's positions. A benchmark window (13 consecutive words) is
looked up through its rarest terms, by counts over the whole corpus: their position lists are moved back by the terms'
offsets in the window and intersected, rarest first. What is left is compared word by word with the document.
Postings are kept for terms that some window is looked up by, so frequent words are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabprobe.llm.common import ascii_lower, written

#: What lies between words (after lower-casing A-Z), and the words of a window.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 13
#: The end of a document is a posting of this term, at the position after its last word. No word is empty.
END = ""
#: A table of terms is broadcast up to so many rows (some tens of MB of words); beyond it is shuffled.
BROADCAST_TERMS = 200_000


def words_of_text(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def _document_key(docs: DataFrame) -> list[Column]:
    """A document is its id and a hash of its text; rows that share both are equal."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")]


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` (written) with a broadcast hint where its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``phrase, words, items``: distinct windows and the items that have them. An item of fewer words is one window.

    Null and empty items have none; an item without an id is matched and not listed.
    """
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of_text(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    windows = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("words"))
    return windows.withColumn("phrase", F.array_join("words", " ")).groupBy("phrase").agg(
        F.first("words").alias("words"), F.collect_set("item_id").alias("items"))


def term_counts(docs: DataFrame) -> DataFrame:
    """``term, uses`` over all words of all documents."""
    return docs.select(F.explode(words_of_text(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("uses"))


def window_anchors(windows: DataFrame, counts: DataFrame, terms: int = 3) -> DataFrame:
    """``phrase, size, items, anchors``: each window with its rarest terms (rarest first) and their first offsets.

    A window with a word that no document has is left out: it cannot occur.
    """
    offsets = windows.select("phrase", F.posexplode("words").alias("offset", "term")).groupBy("phrase", "term").agg(
        F.min("offset").alias("offset"))
    known = offsets.join(counts, "term", "left")
    lists = known.groupBy("phrase").agg(
        F.bool_and(F.col("uses").isNotNull()).alias("possible"),
        F.slice(F.array_sort(F.collect_list(F.struct("uses", "term", "offset"))), 1, terms).alias("anchors"))
    return windows.join(lists.where("possible").drop("possible"), "phrase").select(
        "phrase", F.size("words").alias("size"), "items", "anchors")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, h, term, positions``: postings of ``terms`` (column ``term``) and the ends of all documents."""
    wanted = written(terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct(), "terms")
    places = docs.select(*_document_key(docs), F.posexplode(F.array_append(words_of_text(F.col("text")), F.lit(END))).alias("p", "term"))
    found = places.join(_bounded(wanted), "term")
    return found.groupBy("doc_id", "h", "term").agg(F.array_sort(F.collect_list("p")).alias("positions"))


def _moved(positions: str, offset: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(positions, lambda p: p - offset), lambda s: s >= 0))


def intersect(index: DataFrame, anchors: DataFrame, terms: int = 3, slack: int = 3) -> DataFrame:
    """``doc_id, h, phrase, size, items, near, starts`` for windows whose rarest terms meet in a document.

    ``starts``: window starts where all of them are at their offsets; ``near``: those of the rarest term with the others
    at most ``slack`` words off (starts included). Lists are intersected from the rarest term on.
    """
    anchors = written(anchors, "anchors")
    index = index.where(F.col("term") != END)
    first = anchors.withColumn("term", F.col("anchors")[0]["term"])
    found = index.join(_bounded(first), "term").withColumn("near", _moved("positions", F.col("anchors")[0]["offset"]))
    found = found.withColumn("starts", F.col("near")).drop("term", "positions").where(F.size("near") > 0)
    for k in range(1, terms):
        anchor = F.get("anchors", F.lit(k))
        lists = index.select(F.col("doc_id").alias("d"), F.col("h").alias("h2"), F.col("term").alias("t"), "positions")
        found = found.withColumn("t_k", anchor["term"]).join(
            lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("h2")) & (F.col("t_k") == F.col("t")), "left")
        other = F.coalesce(_moved("positions", anchor["offset"]), F.array().cast("array<int>"))
        around = F.flatten(F.transform(other, lambda s: F.sequence(s - slack, s + slack)))
        # a window with fewer different words has no further list
        found = found.withColumn("starts", F.when(anchor.isNull(), F.col("starts")).otherwise(F.array_intersect("starts", other)))
        found = found.withColumn("near", F.when(anchor.isNull(), F.col("near")).otherwise(F.array_intersect("near", around)))
        found = found.drop("d", "h2", "t", "positions", "t_k").where(F.size("near") > 0)
    return found.drop("anchors")


def phrase_matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, h, matches``: windows (start, size, items) whose words all stand in the document, one row a document.

    Only texts of documents with intersected starts are compared, word by word.
    """
    per = found.where(F.size("starts") > 0).groupBy("doc_id", "h").agg(
        F.collect_list(F.struct("phrase", "size", "items", "starts")).alias("found")).select(
        F.col("doc_id").alias("d"), F.col("h").alias("h2"), "found")
    texts = docs.select(*_document_key(docs), F.col("text"))
    joined = texts.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("h2"))).select(
        "doc_id", "h", words_of_text(F.col("text")).alias("words"), "found")
    each = F.flatten(F.transform("found", lambda e: F.transform(e["starts"], lambda s: F.struct(
        s.alias("start"), e["size"].alias("size"), e["phrase"].alias("phrase"), e["items"].alias("items")))))
    equal = F.filter(each, lambda m: F.array_join(F.slice("words", m["start"] + 1, m["size"]), " ") == m["phrase"])
    slim = F.transform(equal, lambda m: F.struct(m["start"], m["size"], m["items"]))
    return joined.select("doc_id", "h", slim.alias("matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, terms: int = 3, slack: int = 3,
                  share: int = 20) -> DataFrame:
    """A row a document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, h``.

    ``n_hit``: words inside any occurrence of a window; ``n_items``: items with occurring windows; contaminated where
    n_hit > 0 and share * n_hit >= n_words. ``n_near_items``: items with a window whose rarest terms are near each other.
    Null and empty texts have no words and are clean; null and repeated ids keep a row each; other columns are ignored;
    an empty benchmark leaves all documents clean, an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = written(benchmark_windows(benchmark, size), "windows")
    tested = windows.select(F.explode("words").alias("term")).distinct()
    counts = term_counts(docs).join(tested, "term", "left_semi")
    anchors = written(window_anchors(windows, counts, terms), "anchors")
    index = written(build_index(docs, anchors.select(F.explode("anchors.term").alias("term"))), "postings")
    found = written(intersect(index, anchors, terms, slack), "found")
    hits = phrase_matches(docs, found)
    covered = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["size"] - 1))))
    items = F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"])))
    # rows that share id and text are equal, one of them says it
    hits = hits.dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("d"), F.col("h").alias("h2"),
                                                       F.size(covered).cast("long").alias("n_hit"), items.alias("item_ids"))
    near = found.groupBy("doc_id", "h").agg(F.size(F.array_distinct(F.flatten(F.collect_list("items")))).cast("long").alias("n_near_items"))
    near = near.select(F.col("doc_id").alias("d3"), F.col("h").alias("h3"), "n_near_items")
    every = index.where(F.col("term") == END).select("doc_id", "h", F.explode(F.col("positions").cast("array<bigint>")).alias("n_words"))
    joined = every.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("h2")), "left").join(
        near, F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("h") == F.col("h3")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.array_sort(F.transform(F.coalesce("item_ids", F.array().cast("array<string>")), lambda i: i.cast("string")))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near_items", F.lit(0).cast("long")).alias("n_near_items"), "h")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated rows (see ``decontaminate``), all columns as they are.

    Null and empty texts stay; equal rows stay or go together; an empty benchmark keeps all rows; columns may have any names.
    """
    none = F.lit(-(2**63))
    bad = decontaminate(docs, benchmark, **options).where("contaminated").select(
        F.coalesce("doc_id", none).alias("__d"), F.col("h").alias("__h")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("__d"),
                        F.xxhash64(F.col("text").cast("string")).alias("__h"))
    return keyed.join(bad, ["__d", "__h"], "left_anti").select("row.*")
