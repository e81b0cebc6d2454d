"""From clean rows to the daily store x product matrix and its leak-safe features."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.functions.holidays import us_holidays
from shelfcast.session import kept

SERIES = ("store_id", "product")
LAGS, WINDOWS = (1, 7, 14, 28), (7, 14, 28)
WARMUP = max(*LAGS, *WINDOWS)
CALENDAR = ("dow", "is_weekend", "day_of_month", "month", "week_of_year", "day_of_year", "days_since_start", "dow_sin", "dow_cos", "month_sin", "month_cos", "is_holiday", "days_to_nearest_holiday")
HISTORY = (
    *(f"demand_lag_{n}" for n in LAGS), *(f"demand_roll{k}_{n}" for n in WINDOWS for k in ("mean", "std", "max")),
    "demand_same_dow_mean4", "demand_momentum_7", "demand_expanding_mean", "price_lag_1", "price_change_1", "txn_count_lag_1",
)
ZERO_FILLED = ("demand", "revenue", "txn_count", "refund_units", "outlier_txns")
DAILY = ("store_id", "product", "business_date", "category", "demand", "revenue", "txn_count", "avg_unit_price", "refund_units", "outlier_txns")


def daily_rows(clean: DataFrame) -> DataFrame:
    """aggregate_daily, and `_last_category`, the greatest category where `category` is the least: both tell whether a product has several."""
    q = F.col("quantity")
    return clean.dropna(subset=["store_id", "product", "business_date"]).groupBy("store_id", "product", "business_date").agg(
        F.min("category").alias("category"), F.sum(q).alias("demand"), F.sum("amount").alias("revenue"), F.count("transaction_id").alias("txn_count"),
        F.avg("unit_price").alias("avg_unit_price"), F.coalesce(F.sum(F.when(q < 0, q)), F.lit(0.0)).alias("refund_units"), F.sum(F.col("is_stat_outlier").cast("long")).alias("outlier_txns"),
        F.max("category").alias("_last_category"),
    )


def aggregate_daily(clean: DataFrame) -> DataFrame:
    """One row for each store, product and business date; rows with a null key are dropped. Refunds net in the sums."""
    return daily_rows(clean).drop("_last_category")


def distinct_series(daily: DataFrame) -> DataFrame:
    return daily.select("store_id", "product", "category").distinct()


@dataclass(frozen=True)
class Span:
    """What a table of daily rows covers: its series (store_id, product, category; a row each, stored) and the first and last day of all of them, None without rows."""

    series: DataFrame
    first: date | None
    last: date | None

    def days(self) -> DataFrame:
        """business_date: every day from the first to the last, made from these two dates alone."""
        n = (self.last - self.first).days + 1 if self.first else 0
        return self.series.sparkSession.range(n).select(F.date_add(F.lit(self.first).cast("date"), F.col("id").cast("int")).alias("business_date"))


def span_of(daily: DataFrame, mixed: str = "raise") -> Span:
    """Series and days of daily (stored, or cheap to make again) in one pass; from the stored series, which are few, everything else follows.

    A category has to depend on the product, else a series would fall apart. Where a series has several, mixed="raise" raises ValueError with their number
    and the first of them; mixed="least" puts all its rows under the least category.
    """
    other = "_last_category" if "_last_category" in daily.columns else "category"
    per = daily.groupBy(*SERIES).agg(F.min("category").alias("category"), F.max(other).alias("_other"), F.min("business_date").alias("_a"), F.max("business_date").alias("_b"))
    per = kept(per, "series")
    several = F.col("category") != F.col("_other")
    row = per.agg(F.min("_a").alias("a"), F.max("_b").alias("b"), F.count_if(several).alias("n"), F.min(F.when(several, F.struct(*SERIES))).alias("which")).first()
    if row["n"] and mixed == "raise":
        raise ValueError(f"{row['n']} series have several categories; the first is store {row['which'][0]}, product {row['which'][1]}")
    return Span(per.select(*SERIES, "category"), row["a"], row["b"])


def date_span(daily: DataFrame) -> DataFrame:
    """business_date: every day from the first to the last of all series; one row a day, so it is small whatever the number of rows."""
    ends = daily.agg(F.min("business_date").alias("a"), F.max("business_date").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("business_date"))


def complete_calendar(daily: DataFrame, span: Span | None = None) -> DataFrame:
    """Gap-free series: a missing day has zeros, and no price. Without `span`, daily is looked at once for it.

    Grid cells are appended to the daily rows as placeholders and met by one aggregation, so cells and rows share the one shuffle by series that the
    windows need later; a join would want a partitioning by all three keys. The second aggregation has at most two rows a key.
    """
    span = span or span_of(daily)
    grid = span.series.crossJoin(F.broadcast(span.days()))
    types = dict(daily.dtypes)
    empty = [F.lit(None).cast(types[c]).alias(c) if c not in ("store_id", "product", "category", "business_date") else F.col(c) for c in DAILY]
    rows = daily.select(*DAILY).unionByName(grid.select(*empty)).repartition(*SERIES)
    filled = [F.coalesce(F.max(c), F.lit(0).cast(types[c])).alias(c) for c in ZERO_FILLED]
    return rows.groupBy(*SERIES, "business_date").agg(F.min("category").alias("category"), *filled, F.max("avg_unit_price").alias("avg_unit_price")).select(*DAILY)


def nearest_holiday(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """dates with is_holiday and days_to_nearest_holiday (0 on a holiday, null without holidays); both tables have a row a day at most."""
    near = dates.crossJoin(F.broadcast(holidays)).groupBy("business_date").agg(F.min(F.abs(F.datediff("business_date", "holiday"))).alias("days_to_nearest_holiday"))
    out = dates.join(F.broadcast(near), "business_date", "left")
    return out.withColumn("is_holiday", F.coalesce((F.col("days_to_nearest_holiday") == 0).cast("int"), F.lit(0)))


def calendar_columns(dates: DataFrame) -> DataFrame:
    """Calendar columns for a table of dates."""
    d, turn = F.col("business_date"), 2 * F.pi()
    first = dates.agg(F.min("business_date").alias("_first"))
    out = dates.crossJoin(F.broadcast(first)).select(
        d, F.weekday(d).alias("dow"), (F.weekday(d) >= 5).cast("int").alias("is_weekend"), F.dayofmonth(d).alias("day_of_month"), F.month(d).alias("month"),
        F.weekofyear(d).alias("week_of_year"), F.dayofyear(d).alias("day_of_year"), F.datediff(d, F.col("_first")).alias("days_since_start"),
    )
    for c, n in (("dow", 7), ("month", 12)):
        out = out.withColumn(f"{c}_sin", F.sin(turn * F.col(c) / n)).withColumn(f"{c}_cos", F.cos(turn * F.col(c) / n))
    return out


def calendar_table(spark: SparkSession, dates: DataFrame, first: date | None, last: date | None, holidays: DataFrame | None = None) -> DataFrame:
    """business_date and CALENDAR for `dates`, which run from first to last. Holidays default to the US ones of those years."""
    if holidays is None:
        holidays = us_holidays(spark, first.year, last.year) if first else us_holidays(spark, 1970, 1970).limit(0)
    return calendar_columns(dates).join(nearest_holiday(dates, holidays), "business_date").select("business_date", *CALENDAR)


def add_calendar_features(daily: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Calendar columns for any table with business_date, counted from its first day: made once a day and joined by broadcast, a row a day."""
    first, last = daily.agg(F.min("business_date"), F.max("business_date")).first()
    span = Span(daily, first, last)
    return daily.join(F.broadcast(calendar_table(daily.sparkSession, span.days(), first, last, holidays)), "business_date")


def _ordered() -> Window:
    return Window.partitionBy(*SERIES).orderBy("business_date")


def _past(f: Column, days: int | None, least: int) -> Column:
    """An aggregate over the rows before the present one, null with fewer than `least` values."""
    w = _ordered().rowsBetween(-days if days else Window.unboundedPreceding, -1)
    return F.when(F.count("demand").over(w) >= least, f.over(w))


def add_lag_features(daily: DataFrame, anchor: str = "yesterday") -> DataFrame:
    """Lags and rolling statistics that end on the day before. All frames share one partitioning and order: one exchange, one sort.

    demand_same_dow_mean4 averages days t-1, t-8, t-15 and t-22 (those that exist, from 7 past days on); with anchor="same_dow" days t-7, t-14, t-21 and t-28.
    """
    w = _ordered()
    columns = {f"demand_lag_{n}": F.lag("demand", n).over(w) for n in LAGS}
    for n in WINDOWS:
        least = max(2, n // 2)
        columns |= {f"demand_rollmean_{n}": _past(F.avg("demand"), n, least), f"demand_rollstd_{n}": _past(F.stddev_samp("demand"), n, least), f"demand_rollmax_{n}": _past(F.max("demand"), n, least)}
    back = [F.lag("demand", n).over(w) for n in ((1, 8, 15, 22) if anchor == "yesterday" else (7, 14, 21, 28))]
    present = sum((F.when(b.isNotNull(), 1).otherwise(0) for b in back), F.lit(0))
    mean = sum((F.coalesce(b, F.lit(0.0)) for b in back), F.lit(0.0)) / present
    position = F.row_number().over(w) - 1
    columns["demand_same_dow_mean4"] = F.when((position >= 7) & ~position.isin(7, 14, 21), mean)
    columns["demand_momentum_7"] = F.lag("demand", 1).over(w) - F.lag("demand", 7).over(w)
    columns["demand_expanding_mean"] = _past(F.avg("demand"), None, 7)
    return daily.withColumns(columns)


def add_price_features(daily: DataFrame) -> DataFrame:
    """avg_unit_price filled forward, and its lag and change; the count of transactions of the day before."""
    w = _ordered()
    filled = daily.withColumn("avg_unit_price", F.last("avg_unit_price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    filled = filled.withColumn("price_lag_1", F.lag("avg_unit_price", 1).over(w)).withColumn("txn_count_lag_1", F.lag("txn_count", 1).over(w))
    return filled.withColumn("price_change_1", F.col("avg_unit_price") - F.col("price_lag_1"))


def drop_warmup(features: DataFrame, rows: int = WARMUP) -> DataFrame:
    position = features.withColumn("_position", F.row_number().over(_ordered()))
    return position.where(F.col("_position") > rows).drop("_position")


def build_features(clean: DataFrame, holidays: DataFrame | None = None, warmup: bool = True, mixed: str = "raise") -> DataFrame:
    """The whole matrix: daily rows, gap-free calendar, history, price and calendar columns, without the warm-up rows of each series.

    clean is read once: the daily rows are stored, series and days come from one aggregate of them (see span_of for `mixed`), and the calendar is made from two dates.
    """
    daily = kept(daily_rows(clean), "daily")
    span = span_of(daily, mixed)
    out = add_price_features(add_lag_features(complete_calendar(daily, span)))
    out = drop_warmup(out) if warmup else out
    table = calendar_table(clean.sparkSession, span.days(), span.first, span.last, holidays)
    return out.join(F.broadcast(table), "business_date").select(*DAILY, *CALENDAR, *HISTORY)


def keep_matrix(features: DataFrame) -> tuple[DataFrame, date | None]:
    """The matrix stored, and its last day, which is observed while it is written: splits and folds need no second pass."""
    seen = Observation("matrix")
    stored = kept(features.observe(seen, F.max("business_date").alias("last_day")), "matrix")
    return stored, seen.get["last_day"]


def verify_no_leakage(features: DataFrame) -> DataFrame:
    """For each series: rows where the 7-day mean differs from the mean up to the day before, and rows where it equals the leaky mean."""
    w = _ordered()
    leaky = F.when(F.count("demand").over(w.rowsBetween(-6, 0)) >= 3, F.avg("demand").over(w.rowsBetween(-6, 0)))
    rows = features.withColumn("_leaky", leaky)
    rows = rows.withColumn("_before", F.lag("_leaky", 1).over(w)).withColumn("_position", F.row_number().over(w))
    off = F.abs(F.col("demand_rollmean_7") - F.col("_before")) > 1e-9
    return rows.groupBy(*SERIES).agg(F.count_if((F.col("_position") > 7) & off).alias("mismatches"), F.count_if(F.abs(F.col("demand_rollmean_7") - F.col("_leaky")) > 1e-9).alias("differs_from_leaky"))


def feature_nan_audit(features: DataFrame) -> DataFrame:
    """Number of rows, and of rows with any null feature."""
    any_null = F.greatest(*[F.col(c).isNull().cast("int") for c in (*CALENDAR, *HISTORY)]) == 1
    return features.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(any_null).alias("rows_with_null"))


def demand_profile(features: DataFrame) -> DataFrame:
    return features.groupBy("category").agg(F.avg("demand").alias("mean"), F.stddev_samp("demand").alias("std"), F.min("demand").alias("min"), F.max("demand").alias("max"))


def matrix_profile(features: DataFrame) -> DataFrame:
    """Rows, distinct series, date range, zero-demand days and their share."""
    out = features.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*SERIES)).alias("n_series"), F.min("business_date").alias("first_day"), F.max("business_date").alias("last_day"), F.count_if(F.col("demand") == 0).alias("zero_days"))
    return out.withColumn("zero_share", F.try_divide("zero_days", "n_rows"))
