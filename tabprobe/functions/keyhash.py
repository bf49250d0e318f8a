"""Key hash for samples, folds and splits: the same integer arithmetic in Spark and SQL.

h(key) = ((key mod 2^31) · 1103515245 + 12345) mod 2^31 for BIGINT keys ≥ 0 (the
key is reduced first so the product never overflows); the low 16 bits are
dropped before taking a fold or a percentage. Composite or
string keys are first reduced with ``xxhash64`` (Spark-only). Unlike
``randomSplit``/``sample`` the assignment depends only on the key, so it is the
same under any partitioning and after any task retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprobe.functions.columns import c

# fixed constants of the linear congruential hash
MULT = 1103515245
INC = 12345
MOD = 2147483648


def key_hash(key: Column) -> Column:
    # reduce the key mod 2^31 first: same value for every key ≥ 0, and the product stays < 2^63
    return F.pmod(F.pmod(key.cast("long"), F.lit(MOD)) * F.lit(MULT) + F.lit(INC), F.lit(MOD))


def row_key(cols: Sequence[str]) -> Column:
    """A BIGINT key: one integer column's value, else a hash of the columns (all columns where none are named)."""
    if not cols:
        return F.pmod(F.xxhash64(F.col("*")), F.lit(MOD))
    hashed = F.pmod(F.xxhash64(*[c(x) for x in cols]), F.lit(MOD))
    if len(cols) > 1:
        return hashed
    whole = F.typeof(c(cols[0])).isin("tinyint", "smallint", "int", "bigint")
    return F.when(whole, c(cols[0]).try_cast("bigint")).otherwise(hashed)


def fold_of(key: Column, k: int) -> Column:
    return F.pmod(F.floor(key_hash(key) / 65536), F.lit(k)).cast("int")


def is_test(key: Column, test_pct: int = 20) -> Column:
    return F.pmod(F.floor(key_hash(key) / 65536), F.lit(100)) < test_pct


def sql_hash(key: str) -> str:
    return f"((({key}) % {MOD}) * {MULT} + {INC}) % {MOD}"


def sql_fold(key: str, k: int) -> str:
    return f"CAST(floor({sql_hash(key)} / 65536) % {k} AS INTEGER)"


def sql_is_test(key: str, test_pct: int = 20) -> str:
    return f"(floor({sql_hash(key)} / 65536) % 100 < {test_pct})"
