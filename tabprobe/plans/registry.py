"""Registry of named queries: a Spark callable and, where SQL can express it, a DuckDB oracle.

Names follow ``<inventory id>_<operator>`` (SURVEY §2), e.g. ``b4_numeric_summary``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from tabprobe.plans import q_eda, q_features, q_models, q_profile, q_sources, q_stats  # noqa: F401
