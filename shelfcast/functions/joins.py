"""Joins with tables that are expected to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension (a store, a category) up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def small(dimension: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """dimension marked for broadcast if a look at it finds at most `most` rows; a larger one is left to a shuffled join."""
    return F.broadcast(dimension) if dimension.limit(most + 1).count() <= most else dimension
