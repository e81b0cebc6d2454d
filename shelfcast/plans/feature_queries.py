"""Daily demand and the feature matrix as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import features as fx
from shelfcast.plans import adapters, sql
from shelfcast.plans.cleaning_queries import scratch
from shelfcast.plans.registry import query
from shelfcast.session import kept
from shelfcast.sources import io

_FLOATS = "demand revenue avg_unit_price refund_units"
_HISTORY = " ".join(c for c in fx.HISTORY if c != "txn_count_lag_1")


def clean(spark: SparkSession, d: str) -> DataFrame:
    return adapters.adapt(spark, d, adapters.CLEAN)


def events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.adapt(spark, d, adapters.EVENTS)


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return fx.build_features(clean(spark, d))


def daily(spark: SparkSession, d: str, source: Callable[[SparkSession, str], DataFrame] = clean) -> DataFrame:
    """Daily rows, stored: the calendar and its span read them twice."""
    return kept(fx.aggregate_daily(source(spark, d)), "daily")


def _f(final: str, source: str = adapters.CLEAN, **types: str) -> str:
    return sql.shown(sql.with_(sql.features(source), final), **types)


_KEYS = ("store_id", "product", "business_date")


@query(sql.shown(sql.with_(sql.daily(adapters.CLEAN), "SELECT * FROM daily"), doubles=_FLOATS, dates="business_date"))
def aggregate_daily(spark: SparkSession, d: str) -> DataFrame:
    return fx.aggregate_daily(clean(spark, d))


@query(sql.shown(sql.with_(sql.daily(adapters.EVENTS), "SELECT * FROM daily"), doubles=_FLOATS, dates="business_date"))
def aggregate_daily_events(spark: SparkSession, d: str) -> DataFrame:
    return fx.aggregate_daily(events(spark, d))


@query(sql.with_(sql.daily(adapters.CLEAN), "SELECT DISTINCT store_id, product, category FROM daily"))
def distinct_series(spark: SparkSession, d: str) -> DataFrame:
    return fx.distinct_series(fx.aggregate_daily(clean(spark, d)))


@query(_f("SELECT * FROM filled", doubles=_FLOATS, dates="business_date"))
def complete_calendar(spark: SparkSession, d: str) -> DataFrame:
    return fx.complete_calendar(daily(spark, d))


_CAL_FLOATS = "dow_sin dow_cos month_sin month_cos"
_CAL_LONGS = " ".join(c for c in fx.CALENDAR if c not in _CAL_FLOATS.split())


@query(_f("SELECT * FROM cal", doubles=_CAL_FLOATS, dates="business_date", longs=_CAL_LONGS))
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return fx.add_calendar_features(kept(fx.date_span(fx.aggregate_daily(clean(spark, d))), "dates"))


@query(_f("SELECT * FROM cal", adapters.EVENTS, doubles=_CAL_FLOATS, dates="business_date", longs=_CAL_LONGS))
def calendar_features_events(spark: SparkSession, d: str) -> DataFrame:
    return fx.add_calendar_features(kept(fx.date_span(fx.aggregate_daily(events(spark, d))), "dates"))


@query(_f("SELECT store_id, product, business_date, " + ", ".join(c for c in fx.HISTORY if c.startswith("demand")) + " FROM hist", adapters.EVENTS, doubles=" ".join(c for c in fx.HISTORY if c.startswith("demand")), dates="business_date"))
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.add_lag_features(fx.complete_calendar(daily(spark, d, events)))
    return rows.select(*_KEYS, *[c for c in fx.HISTORY if c.startswith("demand")])


@query(_f("SELECT store_id, product, business_date, avg_unit_price, price_lag_1, price_change_1, txn_count_lag_1 FROM hist", adapters.EVENTS, doubles="avg_unit_price price_lag_1 price_change_1", dates="business_date"))
def price_features(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.add_price_features(fx.complete_calendar(daily(spark, d, events)))
    return rows.select(*_KEYS, "avg_unit_price", "price_lag_1", "price_change_1", "txn_count_lag_1")


@query(_f("SELECT store_id, product, count(*) AS n, CAST(min(business_date) AS VARCHAR) AS first_day FROM feat GROUP BY store_id, product"))
def drop_warmup(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).groupBy("store_id", "product").agg(F.count(F.lit(1)).alias("n"), F.min("business_date").alias("first_day"))


_MATRIX = "SELECT " + ", ".join((*fx.DAILY, *fx.CALENDAR, *fx.HISTORY)) + " FROM feat"


@query(_f(_MATRIX, doubles=f"{_FLOATS} {_CAL_FLOATS} {_HISTORY}", dates="business_date", longs=_CAL_LONGS))
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d)


@query(_f("SELECT store_id, count(*) AS n, sum(demand) AS demand FROM feat GROUP BY store_id", doubles="demand"))
def write_features(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    io.write_features(matrix(spark, d), path)
    return io.read_features(spark, path).groupBy("store_id").agg(F.count(F.lit(1)).alias("n"), F.sum("demand").alias("demand"))


@query(
    _f(
        """SELECT store_id, product, count(*) FILTER (p > 7 AND abs(demand_rollmean_7 - before) > 1e-9) AS mismatches, count(*) FILTER (abs(demand_rollmean_7 - leaky) > 1e-9) AS differs_from_leaky
  FROM (SELECT *, lag(leaky) OVER w AS before, row_number() OVER w AS p FROM (SELECT *, CASE WHEN count(demand) OVER v >= 3 THEN avg(demand) OVER v END AS leaky FROM feat WINDOW v AS (PARTITION BY store_id, product ORDER BY business_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) AS a
    WINDOW w AS (PARTITION BY store_id, product ORDER BY business_date)) AS b GROUP BY store_id, product"""
    )
)
def verify_no_leakage(spark: SparkSession, d: str) -> DataFrame:
    return fx.verify_no_leakage(matrix(spark, d))


@query(_f("SELECT count(*) AS n_rows, count(*) FILTER (" + " OR ".join(f"{c} IS NULL" for c in (*fx.CALENDAR, *fx.HISTORY)) + ") AS rows_with_null FROM feat"))
def feature_nan_audit(spark: SparkSession, d: str) -> DataFrame:
    return fx.feature_nan_audit(matrix(spark, d))


@query(_f("SELECT category, avg(demand) AS mean, stddev_samp(demand) AS std, min(demand) AS min, max(demand) AS max FROM feat GROUP BY category", doubles="mean std min max"))
def demand_profile(spark: SparkSession, d: str) -> DataFrame:
    return fx.demand_profile(matrix(spark, d))


@query(_f("SELECT count(*) AS n_rows, count(DISTINCT concat(store_id, '/', product)) AS n_series, min(business_date) AS first_day, max(business_date) AS last_day, count(*) FILTER (demand = 0) AS zero_days, count(*) FILTER (demand = 0) / CAST(count(*) AS DOUBLE) AS zero_share FROM feat", doubles="zero_share", dates="first_day last_day"))
def matrix_profile(spark: SparkSession, d: str) -> DataFrame:
    return fx.matrix_profile(matrix(spark, d))
