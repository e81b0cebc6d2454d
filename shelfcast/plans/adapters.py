"""Projections of the test tables to the library's shapes.

Each is one SQL text that Spark and DuckDB read alike (integer arithmetic, no engine functions), so that both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.session import kept

TABLES = ("nation", "supplier", "part", "lineitem", "events")


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


def _money(x: str) -> str:
    return f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, CAST(CAST(floor(abs({x}) / 100) AS BIGINT) AS STRING), '.', {_pad(f'abs({x}) % 100', 2)})"


STORES = f"""
SELECT concat('S', {_pad('n_nationkey + 1', 4)}) AS store_id,
  CASE n_nationkey % 3 WHEN 0 THEN 'highway' WHEN 1 THEN 'urban' ELSE 'suburban' END AS store_type,
  CASE n_nationkey % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'America/Denver' ELSE 'America/Los_Angeles' END AS timezone,
  CAST(1.0 AS DOUBLE) AS volume_multiplier
FROM nation"""

_SALES = f"""
SELECT CAST(l_orderkey * 7 + l_linenumber + l_partkey AS BIGINT) AS k,
  concat('T-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS transaction_id,
  concat('S', {_pad('s_nationkey + 1', 4)}) AS store_id,
  CASE p_type WHEN 'ECONOMY' THEN 'regular_unleaded' WHEN 'LARGE' THEN 'premium' WHEN 'MEDIUM' THEN 'diesel' WHEN 'PROMO' THEN 'snacks' WHEN 'SMALL' THEN 'beverages' ELSE 'car_wash' END AS product,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'fuel' ELSE 'merchandise' END AS category,
  CAST(l_quantity AS INT) AS quantity, CAST(200 + l_partkey % 300 AS BIGINT) AS price, CAST(l_shipdate AS DATE) AS day
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""

#: Clean transactions without any dirt; every 211th row is marked an outlier.
CLEAN = f"""
SELECT transaction_id, store_id, day AS business_date, product, category, CAST(quantity AS DOUBLE) AS quantity, CAST(price AS DOUBLE) / CAST(100 AS DOUBLE) AS unit_price,
  CAST(quantity * price AS DOUBLE) / CAST(100 AS DOUBLE) AS amount, k % 211 = 0 AS is_stat_outlier
FROM ({_SALES}) AS sales"""

#: A second source: short and dense.
EVENTS = """
SELECT CAST(event_id AS STRING) AS transaction_id, concat('S', lpad(CAST(user_id % 25 + 1 AS STRING), 4, '0')) AS store_id, CAST(ts AS DATE) AS business_date,
  event_type AS product, CASE WHEN event_type IN ('view', 'click') THEN 'fuel' ELSE 'merchandise' END AS category, value AS quantity,
  CAST(2 + user_id % 7 AS DOUBLE) AS unit_price, value * (2 + user_id % 7) AS amount, event_id % 211 = 0 AS is_stat_outlier
FROM events"""

_STEP1 = f"""
SELECT *, 300 + k * 37 % 1080 + CASE WHEN k % 20 = 19 THEN k % 180 - 90 ELSE 0 END AS minute,
  CASE WHEN k % 25 = 0 THEN CASE k % 3 WHEN 0 THEN concat('  ', upper(product), ' ') WHEN 1 THEN CASE product WHEN 'regular_unleaded' THEN 'Reg  Unleaded' WHEN 'beverages' THEN 'Beverage' WHEN 'car_wash' THEN 'CarWash' ELSE upper(product) END
    ELSE concat(upper(substr(product, 1, 1)), substr(product, 2)) END ELSE product END AS label,
  CASE WHEN k % 83 = 0 THEN -quantity ELSE quantity END AS q1,
  CASE WHEN k % 83 = 0 THEN -1 ELSE 1 END * CASE WHEN k % 701 = 0 THEN -1 ELSE 1 END * quantity * price AS a1
FROM ({_SALES}) AS sales"""

_STEP2 = f"""
SELECT *, CASE WHEN k % 509 = 0 THEN 0 ELSE q1 END AS q2, CAST(CASE WHEN k % 167 = 0 THEN floor(a1 * 3 / 2) ELSE a1 END AS BIGINT) AS a2, CASE WHEN k % 251 = 0 THEN price * 100 ELSE price END AS p2
FROM ({_STEP1}) AS step1"""

# k % 613 = 0: half past two on a day on which clocks are put forward at two, or half past one on a day on which that hour comes twice.
_STEP3 = f"""
SELECT *, CASE WHEN k % 211 = 0 THEN CASE category WHEN 'fuel' THEN 59 ELSE 50 END WHEN k % 397 = 0 THEN q2 * 10 ELSE q2 END AS q3,
  CASE WHEN k % 211 = 0 THEN 44250 WHEN k % 397 = 0 THEN q2 * 10 * p2 ELSE a2 END AS a3,
  CASE WHEN k % 211 = 0 THEN CASE category WHEN 'fuel' THEN 750 ELSE 885 END ELSE p2 END AS p3,
  CASE WHEN k % 613 = 0 THEN CASE k % 2 WHEN 0 THEN DATE '1998-04-05' ELSE DATE '1998-10-25' END ELSE day + CASE WHEN minute >= 1440 THEN 1 ELSE 0 END END AS day3,
  CASE WHEN k % 613 = 0 THEN CASE k % 2 WHEN 0 THEN 150 ELSE 90 END ELSE minute % 1440 END AS minute3
FROM ({_STEP2}) AS step2"""

_CLOCK = f"concat({_pad('CAST(floor(minute3 / 60) AS BIGINT)', 2)}, ':', {_pad('minute3 % 60', 2)})"
_DAY = f"concat(CAST(year(day3) AS STRING), '-', {_pad('month(day3)', 2)}, '-', {_pad('day(day3)', 2)})"

_DIRTY = f"""
SELECT k, transaction_id, CASE WHEN k % 499 = 0 THEN 'S9999' WHEN k % 331 = 0 THEN CAST(NULL AS STRING) ELSE store_id END AS store_id,
  CASE WHEN k % 997 = 0 THEN 'mystery' ELSE label END AS product, category, CAST(q3 AS STRING) AS quantity, {_money('p3')} AS unit_price,
  CASE WHEN k % 503 = 0 THEN 'N/A' WHEN k % 199 = 0 THEN '' ELSE {_money('a3')} END AS amount,
  CASE WHEN k % 907 = 0 THEN 'cheque' WHEN k % 33 = 0 THEN concat(' ', upper(CASE k % 4 WHEN 0 THEN 'credit' WHEN 1 THEN 'debit' WHEN 2 THEN 'cash' ELSE 'mobile' END), ' ')
    ELSE CASE k % 4 WHEN 0 THEN 'credit' WHEN 1 THEN 'debit' WHEN 2 THEN 'cash' ELSE 'mobile' END END AS payment_type,
  CASE WHEN k % 5 = 0 THEN concat('L', CAST(k % 1000 AS STRING)) ELSE 'None' END AS loyalty_id,
  CASE WHEN k % 1009 = 0 THEN '2031-01-01T00:00:00Z' WHEN k % 887 = 0 THEN 'not a date'
    WHEN k % 20 <= 10 OR k % 20 = 19 THEN concat({_DAY}, 'T', {_CLOCK}, ':00Z')
    WHEN k % 20 <= 15 THEN concat({_DAY}, ' ', {_CLOCK}, ':00')
    ELSE concat({_pad('month(day3)', 2)}, '/', {_pad('day(day3)', 2)}, '/', CAST(year(day3) AS STRING), ' ', {_CLOCK}) END AS transaction_ts
FROM ({_STEP3}) AS step3"""

_COLUMNS = "transaction_id, store_id, product, category, quantity, unit_price, amount, payment_type, loyalty_id, transaction_ts"

#: Raw transactions with planted dirt.
RAW = f"""
SELECT {_COLUMNS} FROM ({_DIRTY}) AS dirty
UNION ALL SELECT {_COLUMNS} FROM ({_DIRTY}) AS again WHERE k % 67 = 0
UNION ALL SELECT transaction_id, store_id, product, category, quantity, unit_price, amount, payment_type, 'LX' AS loyalty_id, transaction_ts FROM ({_DIRTY}) AS conflicting WHERE k % 101 = 0"""

#: Rows planted for each issue, before overlaps, in the names of the ledger.
LEDGER = f"""
SELECT count(CASE WHEN k % 67 = 0 THEN 1 END) + count(CASE WHEN k % 101 = 0 THEN 1 END) AS duplicates, count(CASE WHEN k % 83 = 0 THEN 1 END) AS refunds,
  count(CASE WHEN k % 499 = 0 THEN 1 END) AS orphan_store, count(CASE WHEN k % 509 = 0 THEN 1 END) AS zero_quantity,
  count(CASE WHEN k % 167 = 0 THEN 1 END) + count(CASE WHEN k % 251 = 0 THEN 1 END) AS amount_mismatch
FROM ({_DIRTY}) AS dirty"""


def adapt(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of one of the texts above, over the tables in sf_dir.

    Where the text has the dirty sales, their numbers are stored first: the text names them several times in each of several places, and one projection of all steps would be too large to compile well.
    """
    part = f"({_STEP3}) AS step3"
    if part in text:
        numbers = kept(adapt(spark, sf_dir, _STEP3), "sales")
        return spark.sql(text.replace(part, "{step3}"), step3=numbers)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in text}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **tables)
