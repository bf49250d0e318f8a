"""Shared helpers of the corpus operators: written tables, salted lookups, vectorised text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.session import ensure_checkpoint_dir

#: A-Z to a-z, nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space as in ``[\x20\x09-\x0D]``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors and the driver share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabprobe-llm/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 32) -> DataFrame:
    """``left`` joined with ``right`` (one row a key) where one key may hold a large share of ``left``.

    Each row of ``right`` is repeated for every salt, each row of ``left`` takes the salt of its own
    content, so a hot key is dealt out over ``salts`` tasks.
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns], F.lit(7)), F.lit(salts)).cast("int")
    lhs = left.withColumn("__salt", salt)
    rhs = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lhs.join(rhs, [*keys, "__salt"], how).drop("__salt")


def numbered(df: DataFrame, group: list[str], order: list[Column], spread: Column, out: str, buckets: int = 64) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps in each group, without one task a group.

    Rows of a group go to ``buckets`` sub-buckets by ``spread``; rows are numbered in a sub-bucket and moved
    on by the sizes of the sub-buckets before it. The sizes are groups x buckets rows.
    """
    from pyspark.sql import Window as W

    b = df.withColumn("__b", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    sizes = b.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*group, "__b", F.coalesce(before, F.lit(0)).alias("__off"))
    ranked = b.withColumn("__rn", F.row_number().over(W.partitionBy(*group, "__b").orderBy(*order)))
    return (ranked.join(offsets, [*group, "__b"])
            .withColumn(out, (F.col("__off") + F.col("__rn") - 1).cast("long")).drop("__b", "__n", "__off", "__rn"))


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of slices of about ``max_bytes`` of text each; a longer text is alone."""
    off = np.concatenate([[0], np.cumsum(byte_lengths(batch.column(column)))])
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        yield i, j - i
        i = j


def byte_lengths(arr: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts (null: none) as one array, and the n + 1 offsets of its rows."""
    lens = byte_lengths(arr)
    off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    data = arr.cast(pa.large_binary()).drop_null()
    if len(data) == 0 or off[-1] == 0:
        return np.zeros(0, np.uint8), off
    first = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[first[0]:first[-1]], off


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: start and end byte of every word, and n + 1 word offsets of the rows."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    solid = ~space
    begins = solid.copy()
    begins[1:] &= space[:-1]
    ends = solid.copy()
    ends[:-1] &= space[1:]
    edges = off[(off > 0) & (off < len(data))]  # a row's first byte begins a word, the byte before ends one
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, off)


def _random_u64(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64 - 1, n, dtype=np.uint64)


_BYTE_HASH = _random_u64(256, 20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ..., n - 1: the products of a row of small powers and a column of large ones."""
    def run(b: np.uint64, size: int) -> np.ndarray:
        out = np.full(size, b, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    step = min(max(n, 1), 1 << 12)
    small = run(base, step)
    large = run(small[-1] * base, -(-n // step))
    return np.multiply.outer(large, small).reshape(-1)[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span, from one running polynomial sum over all bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_HASH[data] * _powers(_BASE, len(data)), out=run[1:])
        inverse = _powers(_BASE_INV, len(data) + 1)
        return mix64((run[stops] - run[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
