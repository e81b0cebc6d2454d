import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.holidays import holiday_dates
from shelfcast.operators import features as fx

SCHEMA = "transaction_id string, store_id string, product string, business_date date, category string, quantity double, amount double, unit_price double, is_stat_outlier boolean"


def sales(spark, values, start=date(2024, 1, 1), product="diesel"):
    """One sale a day; None leaves the day out."""
    rows = [(f"t{i}", "S1", product, start + timedelta(days=i), "fuel", float(v), 2.0 * v, 2.0 + i, False) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, SCHEMA)


def by_day(df):
    return [r.asDict() for r in df.orderBy("business_date").collect()]


def test_daily(spark):
    rows = sales(spark, [5]).union(sales(spark, [-2])).union(sales(spark, [3]).withColumn("store_id", F.lit(None).cast("string")))
    (got,) = fx.aggregate_daily(rows).collect()
    assert (got["demand"], got["refund_units"], got["txn_count"], got["revenue"]) == (3.0, -2.0, 2, 6.0)


def test_calendar_fills_gaps_over_all_series(spark):
    rows = fx.aggregate_daily(sales(spark, [1, None, None, None, 4]).union(sales(spark, [7], date(2024, 1, 7), "snacks")))
    full = fx.complete_calendar(rows)
    assert full.count() == 2 * 7
    gap = full.where("product = 'diesel' and business_date = '2024-01-03'").first()
    assert gap["demand"] == 0 and gap["txn_count"] == 0 and gap["avg_unit_price"] is None and gap["category"] == "fuel"


def test_calendar_columns(spark):
    days = spark.createDataFrame([(date(2024, 2, 29),), (date(2024, 12, 30),), (date(2024, 12, 25),), (date(2024, 1, 1),)], "business_date date")
    got = {r["business_date"]: r for r in fx.add_calendar_features(days).collect()}
    assert got[date(2024, 12, 30)]["week_of_year"] == 1 and got[date(2024, 2, 29)]["day_of_year"] == 60
    assert got[date(2024, 12, 25)]["days_to_nearest_holiday"] == 0 and got[date(2024, 12, 25)]["is_holiday"] == 1
    assert got[date(2024, 12, 30)]["days_to_nearest_holiday"] == 5 and got[date(2024, 1, 1)]["days_since_start"] == 0


def test_holiday_rules():
    days = holiday_dates(2021, 2023)
    assert date(2021, 6, 19) in days and date(2021, 6, 18) in days and date(2023, 1, 2) in days and date(2022, 11, 24) in days
    assert date(2021, 12, 31) in days and date(2020, 12, 25) not in days and not any(d.month == 6 for d in holiday_dates(2020, 2020))


def test_lags_of_a_ramp(spark):
    rows = by_day(fx.add_lag_features(fx.complete_calendar(fx.aggregate_daily(sales(spark, range(40))))))
    assert rows[28]["demand_same_dow_mean4"] == pytest.approx(16.5) and rows[28]["demand_lag_28"] == 0 and rows[28]["demand_momentum_7"] == 6
    assert rows[2]["demand_rollmean_7"] is None and rows[3]["demand_rollmean_7"] == 1 and rows[3]["demand_rollstd_7"] == 1
    assert rows[13]["demand_rollmax_28"] is None and rows[14]["demand_rollmax_28"] == 13
    assert rows[6]["demand_expanding_mean"] is None and rows[7]["demand_expanding_mean"] == 3
    assert rows[6]["demand_same_dow_mean4"] is None and rows[7]["demand_same_dow_mean4"] is None and rows[8]["demand_same_dow_mean4"] == 3.5
    same = by_day(fx.add_lag_features(fx.complete_calendar(fx.aggregate_daily(sales(spark, range(40)))), anchor="same_dow"))
    assert same[35]["demand_same_dow_mean4"] == pytest.approx((28 + 21 + 14 + 7) / 4)


def test_price_is_filled_forward(spark):
    rows = by_day(fx.add_price_features(fx.complete_calendar(fx.aggregate_daily(sales(spark, [1, None, 1])))))
    assert [r["avg_unit_price"] for r in rows] == [2.0, 2.0, 4.0] and [r["price_change_1"] for r in rows] == [None, 0.0, 2.0] and rows[2]["txn_count_lag_1"] == 0


def test_matrix_has_one_exchange_by_series_for_all_windows(spark):
    matrix = fx.build_features(sales(spark, range(60)))
    assert matrix.count() == 60 - 28 and len(matrix.columns) == 42
    assert fx.feature_nan_audit(matrix).first()["rows_with_null"] == 0
    assert fx.verify_no_leakage(matrix).first()["mismatches"] == 0
    plan = fx.add_price_features(fx.add_lag_features(fx.complete_calendar(fx.aggregate_daily(sales(spark, range(60))))))._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Window") :] if "Window" in plan else plan
    assert re.split("(?:Hash|Sort)Aggregate", final)[0].count("Exchange") == 0


def test_a_product_of_two_categories_is_reported(spark):
    rows = sales(spark, range(40)).withColumn("category", F.when(F.col("quantity") == 7, "other").otherwise(F.col("category")))
    for mixed in (rows, rows.unionByName(sales(spark, range(40)).where("quantity = 7"))):  # on a day of its own, and within a day
        with pytest.raises(ValueError, match="1 series have several categories; the first is store S1, product diesel"):
            fx.build_features(mixed)
        least = fx.build_features(mixed, mixed="least")
        assert least.count() == 40 - 28 and {r["category"] for r in least.collect()} == {"fuel"}


def test_clean_rows_are_read_once_for_the_matrix(spark, tmp_path):
    sales(spark, range(60)).write.parquet(f"{tmp_path}/clean")
    matrix = fx.build_features(spark.read.parquet(f"{tmp_path}/clean"))
    plan = matrix._jdf.queryExecution().optimizedPlan().toString()
    assert "quantity" not in plan and str(tmp_path) not in matrix._jdf.queryExecution().executedPlan().toString()
    stored, last = fx.keep_matrix(matrix)
    assert last == date(2024, 2, 29) and stored.count() == 32
    days = stored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in days and "Window" not in days
    assert fx.keep_matrix(fx.build_features(sales(spark, [])))[1] is None


def test_empty(spark):
    assert fx.build_features(sales(spark, [])).count() == 0
