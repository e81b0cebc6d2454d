"""US federal holidays by rule."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

#: Month and day, with the first year the holiday applies in.
FIXED = ((1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0))
#: Month, weekday (Monday 0), which one of the month (-1: last), first year.
FLOATING = ((1, 0, 3, 1986), (2, 0, 3, 0), (5, 0, -1, 0), (9, 0, 1, 0), (10, 0, 2, 0), (11, 3, 4, 0))


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def holiday_dates(first_year: int, last_year: int) -> list[date]:
    """Holidays and their observed days (Saturday: the day before, Sunday: the day after) that fall in the years."""
    days: set[date] = set()
    for year in range(first_year, last_year + 2):
        for month, day, since in FIXED:
            if year >= since:
                d = date(year, month, day)
                days |= {d, d + timedelta(days={5: -1, 6: 1}.get(d.weekday(), 0))}
        days |= {_nth(year, m, w, n) for m, w, n, since in FLOATING if year >= since}
    return sorted(d for d in days if first_year <= d.year <= last_year)


def us_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """holiday (date): a dozen rows a year."""
    return spark.createDataFrame([(d,) for d in holiday_dates(first_year, last_year)], "holiday date")
