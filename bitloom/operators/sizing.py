"""Broadcast hints that are only given for sides of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; a row here is a key, a few words or coordinates.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows, counted no further than needed; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
