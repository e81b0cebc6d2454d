"""Forecast error aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wape(y: Column, p: Column) -> Column:
    """Sum of absolute errors over sum of absolute actuals; null if the latter is 0."""
    return F.try_divide(F.sum(F.abs(y - p)), F.sum(F.abs(y)))


def error_metrics(y: Column, p: Column) -> list[Column]:
    e = p - y
    return [wape(y, p).alias("wape"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")]


def clipped(c: Column) -> Column:
    """Not below 0; null stays null (greatest alone would make it 0)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
