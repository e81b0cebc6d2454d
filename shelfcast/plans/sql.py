"""SQL forms of the library's steps, for comparison in another engine."""

from __future__ import annotations

from shelfcast.functions.holidays import holiday_dates
from shelfcast.plans import adapters
from shelfcast.schemas import GATES, PRODUCT_MAP

EARLIEST, LATEST = "1995-01-01 00:00:00", "2002-01-01 00:00:00"


def shown(sql: str, doubles: str = "", dates: str = "", longs: str = "") -> str:
    """Doubles rounded, dates as text, counts as BIGINT."""
    parts = [f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql}) AS shown" if parts else sql


def with_(steps: dict[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in steps.items()) + "\n" + final


_PRODUCTS = ", ".join(f"('{a}', '{b}')" for a, b in PRODUCT_MAP.items())
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_ORDER = ", ".join(f"{c} NULLS FIRST" for c in sorted(("transaction_id", "store_id", "product", "category", "quantity", "unit_price", "amount", "payment_type", "loyalty_id", "transaction_ts")))
_FAILS = (
    "id_rank > 1", "product_raw IS NOT NULL AND product IS NULL", "ts_utc IS NULL", f"NOT ts_utc BETWEEN TIMESTAMP '{EARLIEST}' AND TIMESTAMP '{LATEST}'", "store_id IS NULL", "zone IS NULL",
    "coalesce((amount0 < 0) <> (quantity < 0), false)", "coalesce(quantity = 0, false)", "amount IS NULL",
    "coalesce(abs(abs(amount) - round_even(abs(quantity * unit_price) * 100, 0) / 100) > 0.02, false)",
    "NOT is_refund AND coalesce((category = 'fuel' AND (abs(quantity) > 60 OR abs(unit_price) > 8)) OR (category = 'merchandise' AND (abs(unit_price) > 100 OR abs(quantity) > 50)), false)",
)

RAW = {"raw0": adapters.RAW, "raw": "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {c} NOT IN ('', 'None') THEN {c} END AS {c}" for c in ("transaction_id", "store_id", "product", "category", "quantity", "unit_price", "amount", "payment_type", "loyalty_id", "transaction_ts")) + ") FROM raw0", "stores": adapters.STORES}
GATED = RAW | {
    "products": f"SELECT * FROM (VALUES {_PRODUCTS}) AS t(spelling, name)",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY {_ORDER}) AS id_rank FROM (SELECT DISTINCT * FROM raw) AS d",
    "typed": rf"""SELECT r.* EXCLUDE (product, category, payment_type, quantity, unit_price, amount), r.product AS product_raw, r.quantity AS text_quantity, r.unit_price AS text_unit_price, r.amount AS text_amount, p.name AS product, lower(trim(category)) AS category,
      CASE WHEN lower(trim(payment_type)) IN ('credit', 'debit', 'cash', 'mobile') THEN lower(trim(payment_type)) ELSE 'other' END AS payment_type,
      CASE WHEN regexp_matches(quantity, '{_NUMBER}') THEN CAST(quantity AS DOUBLE) END AS quantity, CASE WHEN regexp_matches(unit_price, '{_NUMBER}') THEN CAST(unit_price AS DOUBLE) END AS unit_price,
      CASE WHEN regexp_matches(amount, '{_NUMBER}') THEN CAST(amount AS DOUBLE) END AS amount0, s.timezone AS zone,
      CASE WHEN transaction_ts LIKE '%Z' THEN try_strptime(transaction_ts, '%Y-%m-%dT%H:%M:%SZ') END AS instant,
      CASE WHEN transaction_ts NOT LIKE '%Z' THEN coalesce(try_strptime(transaction_ts, '%Y-%m-%d %H:%M:%S'), try_strptime(transaction_ts, '%m/%d/%Y %H:%M')) END AS wall
      FROM ranked AS r LEFT JOIN stores AS s ON r.store_id = s.store_id LEFT JOIN products AS p ON regexp_replace(lower(trim(r.product)), '\s+', ' ', 'g') = p.spelling""",
    "walls": "SELECT *, timezone('UTC', timezone(zone, wall)) AS u FROM typed",
    "timed": """SELECT * EXCLUDE (u), coalesce(instant, CASE WHEN timezone(zone, timezone('UTC', u)) <> wall THEN date_trunc('hour', timezone('UTC', timezone(zone, wall + INTERVAL 1 HOUR)))
      WHEN timezone(zone, timezone('UTC', u + INTERVAL 1 HOUR)) = wall OR timezone(zone, timezone('UTC', u - INTERVAL 1 HOUR)) = wall THEN NULL ELSE u END) AS ts_utc FROM walls""",
    "derived": """SELECT *, timezone(zone, timezone('UTC', ts_utc)) AS local, CAST(timezone(zone, timezone('UTC', ts_utc)) AS DATE) AS business_date, coalesce(amount0 < 0 AND quantity < 0, false) AS is_refund,
      amount0 IS NULL AND quantity IS NOT NULL AND unit_price IS NOT NULL AS repaired, coalesce(amount0, round_even(quantity * unit_price * 100, 0) / 100) AS amount FROM timed""",
    "gated": "SELECT *, CASE " + " ".join(f"WHEN {t} THEN '{g}'" for g, t in zip(GATES, _FAILS, strict=True)) + " END AS reason FROM derived",
    "gates": "SELECT * FROM (VALUES " + ", ".join(f"('{g}', {i + 1})" for i, g in enumerate(GATES)) + ") AS t(reason, gate)",
    "bounds": "SELECT category, q1, q3, round(q1 - 1.5 * (q3 - q1), 9) AS lower, round(q3 + 1.5 * (q3 - q1), 9) AS upper FROM (SELECT category, quantile_cont(abs(amount), 0.25) AS q1, quantile_cont(abs(amount), 0.75) AS q3 FROM gated WHERE reason IS NULL GROUP BY category) AS q",
    "clean": """SELECT g.*, coalesce(abs(amount) < lower OR abs(amount) > upper, false) AS is_stat_outlier, concat(strftime(local, '%Y-%m-%d %H:%M:%S'), CASE WHEN m < 0 THEN '-' ELSE '+' END, lpad(CAST(abs(m) // 60 AS VARCHAR), 2, '0'), lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0')) AS ts_local
      FROM (SELECT *, date_diff('minute', ts_utc, local) AS m FROM gated WHERE reason IS NULL) AS g LEFT JOIN bounds AS b ON g.category IS NOT DISTINCT FROM b.category""",
}


def daily(source: str) -> dict[str, str]:
    return {
        "clean": source,
        "daily": """SELECT store_id, product, business_date, min(category) AS category, sum(quantity) AS demand, sum(amount) AS revenue, count(transaction_id) AS txn_count, avg(unit_price) AS avg_unit_price,
          coalesce(sum(CASE WHEN quantity < 0 THEN quantity END), 0.0) AS refund_units, CAST(sum(CAST(is_stat_outlier AS INT)) AS BIGINT) AS outlier_txns FROM clean WHERE store_id IS NOT NULL AND product IS NOT NULL AND business_date IS NOT NULL GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY store_id, product, business_date"),
    }


_HOLIDAYS = ", ".join(f"(DATE '{d}')" for d in holiday_dates(1992, 2030))
_W = "PARTITION BY store_id, product ORDER BY business_date"
_ROLL = ",\n".join(
    f"CASE WHEN count(demand) OVER w{n} >= {max(2, n // 2)} THEN {f}(demand) OVER w{n} END AS demand_roll{k}_{n}" for n in (7, 14, 28) for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"))
)


def features(source: str) -> dict[str, str]:
    """daily, span, full (gap-free), cal, hist (history columns, all rows), feat (the matrix)."""
    return daily(source) | {
        "span": "SELECT CAST(unnest(generate_series(min(business_date), max(business_date), INTERVAL 1 DAY)) AS DATE) AS business_date FROM daily",
        "filled": """SELECT g.store_id, g.product, g.business_date, g.category, coalesce(demand, 0.0) AS demand, coalesce(revenue, 0.0) AS revenue, coalesce(txn_count, 0) AS txn_count, avg_unit_price, coalesce(refund_units, 0.0) AS refund_units, coalesce(outlier_txns, 0) AS outlier_txns
          FROM (SELECT DISTINCT store_id, product, category, span.business_date FROM daily, span) AS g LEFT JOIN daily AS d ON g.store_id = d.store_id AND g.product = d.product AND g.business_date = d.business_date""",
        "holidays": f"SELECT holiday FROM (VALUES {_HOLIDAYS}) AS t(holiday) WHERE year(holiday) BETWEEN (SELECT min(year(business_date)) FROM span) AND (SELECT max(year(business_date)) FROM span)",
        "cal": """SELECT business_date, isodow(business_date) - 1 AS dow, CASE WHEN isodow(business_date) >= 6 THEN 1 ELSE 0 END AS is_weekend, day(business_date) AS day_of_month, month(business_date) AS month, week(business_date) AS week_of_year, dayofyear(business_date) AS day_of_year,
          date_diff('day', (SELECT min(business_date) FROM span), business_date) AS days_since_start, sin(2 * pi() * (isodow(business_date) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(business_date) - 1) / 7) AS dow_cos, sin(2 * pi() * month(business_date) / 12) AS month_sin, cos(2 * pi() * month(business_date) / 12) AS month_cos,
          CASE WHEN (SELECT min(abs(date_diff('day', holiday, business_date))) FROM holidays) = 0 THEN 1 ELSE 0 END AS is_holiday, (SELECT min(abs(date_diff('day', holiday, business_date))) FROM holidays) AS days_to_nearest_holiday FROM span""",
        "hist0": f"""SELECT *, last_value(avg_unit_price IGNORE NULLS) OVER (PARTITION BY store_id, product ORDER BY business_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price, row_number() OVER ({_W}) - 1 AS position,
          lag(demand, 1) OVER w AS demand_lag_1, lag(demand, 7) OVER w AS demand_lag_7, lag(demand, 14) OVER w AS demand_lag_14, lag(demand, 28) OVER w AS demand_lag_28, lag(demand, 8) OVER w AS b8, lag(demand, 15) OVER w AS b15, lag(demand, 22) OVER w AS b22,
          {_ROLL}, CASE WHEN count(demand) OVER we >= 7 THEN avg(demand) OVER we END AS demand_expanding_mean, lag(txn_count, 1) OVER w AS txn_count_lag_1
          FROM filled WINDOW w AS ({_W}), w7 AS ({_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w14 AS ({_W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), w28 AS ({_W} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), we AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "hist": f"""SELECT * EXCLUDE (avg_unit_price, price, b8, b15, b22), price AS avg_unit_price, demand_lag_1 - demand_lag_7 AS demand_momentum_7, lag(price, 1) OVER ({_W}) AS price_lag_1, price - lag(price, 1) OVER ({_W}) AS price_change_1,
          CASE WHEN position >= 7 AND position NOT IN (7, 14, 21) THEN (coalesce(demand_lag_1, 0) + coalesce(b8, 0) + coalesce(b15, 0) + coalesce(b22, 0)) / ((demand_lag_1 IS NOT NULL)::INT + (b8 IS NOT NULL)::INT + (b15 IS NOT NULL)::INT + (b22 IS NOT NULL)::INT) END AS demand_same_dow_mean4 FROM hist0""",
        "feat": "SELECT h.* EXCLUDE (position), c.* EXCLUDE (business_date) FROM hist AS h JOIN cal AS c ON h.business_date = c.business_date WHERE position >= 28",
    }


