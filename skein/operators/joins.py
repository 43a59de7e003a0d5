"""Joins with a side whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 50_000


def small_join(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``right`` if it has at most ``most`` rows, of which no more are counted; a larger one is shuffled."""
    few = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if few else right, on, how)
