"""Join helpers: broadcast only when the side's row count is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a "metadata-sized" side (per column, per level, per bucket) above which
# the broadcast hint is dropped and AQE chooses the join from runtime sizes.
BROADCAST_ROW_LIMIT = 2_000_000


def bounded_broadcast(df: DataFrame, row_bound: int, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast when ``row_bound`` (a proven upper bound on rows) is under ``limit``."""
    return F.broadcast(df) if row_bound <= limit else df
