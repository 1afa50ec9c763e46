"""Choosing a join by a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of a few plain columns are broadcast up to this many rows; beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows. It is counted, so it should be a written table."""
    return F.broadcast(df) if df.count() <= rows else df
