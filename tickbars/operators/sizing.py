"""Broadcasts only behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.session import use_checkpoints

SMALL_ROWS = 500_000


def small_side(df: DataFrame, max_rows: int | None = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows.

    Counting stops at the limit. A larger side is left to a shuffle join, whose skewed
    partitions adaptive execution splits. With ``max_rows=None`` nothing is counted.
    """
    if max_rows is None:
        return df
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def counted_side(df: DataFrame, max_rows: int | None = SMALL_ROWS) -> DataFrame | None:
    """As :func:`small_side` for a side that is costly to compute: it is kept in the shared
    checkpoint folder and computed once. None if it turns out empty."""
    if max_rows is None:
        return df
    use_checkpoints(df.sparkSession)
    held = df.checkpoint()
    n = held.count()
    if n == 0:
        return None
    return F.broadcast(held) if n <= max_rows else held
