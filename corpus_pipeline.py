"""From raw documents to token shards: toxicity, near copies, benchmark passages, mixing, token ids.

Each stage takes what its predecessor kept, as Parquet, and returns the documents that go on (all their columns); the
last one returns a row a document of the token shards. Rows keep the order that mixing gave them in the shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm.bayes_dedup import without_near_copies
from tabprobe.llm.common import written
from tabprobe.llm.pfair import mixed_documents
from tabprobe.llm.positional_index import without_contaminated
from tabprobe.llm.rans import token_shards
from tabprobe.llm.string_kernel import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject; it learns from ``labels``."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return without_near_copies(docs, width=5, similarity=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of 13 benchmark words."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a Pfair mix of their sources."""
    return mixed_documents(docs)


def shard_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in rANS shards, in the order in which ``docs`` was written, read back.

    Rows that are not read from files have no such order; they are written by ``doc_id``. A column of the documents may
    be named as the hidden one that tells a row's place.
    """
    if not docs.inputFiles():
        return token_shards(docs)
    place = docs.metadataColumn("_metadata")
    place = docs.select("doc_id", "text", F.regexp_extract(place["file_name"], r"part-(\d+)", 1).cast("long").alias("__part"),
                        place["file_name"].alias("__file"), place["row_index"].alias("__row"))
    return token_shards(place, order=[F.col("__part"), F.col("__file"), F.col("__row")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated),
    ("mixing", mix_sources), ("token shards", shard_tokens)]

#: The toxicity machine and the token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
