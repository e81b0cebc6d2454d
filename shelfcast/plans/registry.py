"""Queries by name, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def shown(df: DataFrame) -> DataFrame:
    """Results in types that engines print alike: doubles of six decimals, dates and times as text, whole numbers as long."""
    forms = {"double": lambda c: F.round(c, 6) + 0.0, "date": lambda c: c.cast("string"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "int": lambda c: c.cast("long")}
    return df.select([forms.get(t, lambda c: c)(F.col(f"`{c}`")).alias(c) for c, t in df.dtypes])


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shown(f(prepare(spark), sf_dir))

        QUERIES[f.__name__.rstrip("_")] = run
        if oracle is not None:
            ORACLES[f.__name__.rstrip("_")] = oracle
        return f

    return register


def load() -> None:
    """Fills the registry."""
    from shelfcast.plans import cleaning_queries, feature_queries, forecast_queries, monitor_queries  # noqa: F401


load()
