"""Readers, writers and cleaning as queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.operators import cleaning
from shelfcast.plans import adapters, sql
from shelfcast.plans.registry import query
from shelfcast.schemas import CLEAN_COLUMNS, RAW_COLUMNS, CleaningRules
from shelfcast.session import kept, new_path
from shelfcast.sources import io

RULES = CleaningRules(earliest=sql.EARLIEST, latest=sql.LATEST)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return new_path(spark, "scratch")


def raw(spark: SparkSession, d: str) -> DataFrame:
    return io.validate_schema(adapters.adapt(spark, d, adapters.RAW))


def stores(spark: SparkSession, d: str) -> DataFrame:
    return adapters.adapt(spark, d, adapters.STORES)


def gated(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.gate(raw(spark, d), stores(spark, d), RULES)


def clean(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.survivors(kept(gated(spark, d)))
    return cleaning.finalize(cleaning.flag_stat_outliers(rows, cleaning.iqr_bounds(rows)))


def _g(final: str, **types: str) -> str:
    return sql.shown(sql.with_(sql.GATED, final), **types)


_CLEAN = "SELECT transaction_id, store_id, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, ts_local, CAST(business_date AS VARCHAR) AS business_date, product, category, round(quantity, 6) AS quantity, round(unit_price, 6) AS unit_price, round(amount, 6) AS amount, payment_type, loyalty_id, is_refund, is_stat_outlier FROM clean"


@query(sql.with_(sql.RAW, "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {c} <> '' THEN {c} END AS {c}" for c in RAW_COLUMNS) + ") FROM raw0"))
def read_raw_pos(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    adapters.adapt(spark, d, adapters.RAW).write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return io.read_raw_pos(spark, path)


@query(adapters.STORES)
def read_stores(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    stores(spark, d).write.option("header", True).csv(path)
    return io.read_stores(spark, path)


@query(sql.with_(sql.RAW, "SELECT * FROM raw"))
def validate_schema(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d)


@query(sql.shown(f"SELECT name, injected FROM (UNPIVOT ({adapters.LEDGER}) ON COLUMNS(*) INTO NAME name VALUE injected)"))
def read_ledger(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    spark.createDataFrame([(json.dumps(adapters.adapt(spark, d, adapters.LEDGER).first().asDict()),)], "value string").coalesce(1).write.text(path)
    return io.read_ledger(spark, path)


@query(_g("SELECT business_date, count(*) AS n, sum(amount) AS amount FROM clean GROUP BY business_date", doubles="amount", dates="business_date"))
def write_clean(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    io.write_clean(clean(spark, d), path)
    return spark.read.parquet(path).groupBy("business_date").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(_g("SELECT reason, count(*) AS n FROM gated WHERE reason IS NOT NULL GROUP BY reason"))
def write_quarantine(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    io.write_quarantine(cleaning.quarantine(gated(spark, d)), path)
    return spark.read.parquet(path).groupBy(F.col("_reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(_g("SELECT transaction_id, store_id, product_raw, text_quantity AS quantity, text_unit_price AS unit_price, text_amount AS amount, payment_type, category, loyalty_id, transaction_ts, reason FROM gated WHERE reason IS NOT NULL"))
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.quarantine(gated(spark, d)).select("transaction_id", "store_id", "product_raw", "quantity", "unit_price", "amount", "payment_type", "category", "loyalty_id", "transaction_ts", F.col("_reject_reason").alias("reason"))


@query(_g("SELECT product_raw, product, count(*) AS n FROM gated GROUP BY product_raw, product"))
def normalize_product(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).groupBy("product_raw", "product").agg(F.count(F.lit(1)).alias("n"))


@query(_g("SELECT payment_type, category, count(*) AS n FROM gated GROUP BY payment_type, category"))
def normalize_payment_and_category(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).groupBy("payment_type", "category").agg(F.count(F.lit(1)).alias("n"))


@query(_g("SELECT transaction_id, text_quantity, quantity, text_amount, amount0 AS amount FROM gated WHERE amount0 IS NULL OR quantity < 0", doubles="quantity amount"))
def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    rows = gated(spark, d).withColumn("_a", F.when(~F.col("_repaired"), F.col("amount"))).where("_a is null or quantity < 0")
    return rows.select("transaction_id", F.col("_text_quantity").alias("text_quantity"), "quantity", F.col("_text_amount").alias("text_amount"), F.col("_a").alias("amount"))


@query(_g("SELECT transaction_id, transaction_ts, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, CAST(business_date AS VARCHAR) AS business_date FROM gated"))
def parse_and_localize(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).select("transaction_id", "transaction_ts", "ts_utc", "business_date")


@query(_g("SELECT reason, zone IS NULL AS no_zone, store_id IS NULL AS no_store, count(*) AS n FROM gated GROUP BY 1, 2, 3"))
def attach_store_timezone(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).groupBy(F.col("_reject_reason").alias("reason"), F.col("_zone").isNull().alias("no_zone"), F.col("store_id").isNull().alias("no_store")).agg(F.count(F.lit(1)).alias("n"))


@query(_g("SELECT transaction_id, quantity, unit_price, amount, is_refund, repaired, reason FROM gated WHERE is_refund OR repaired", doubles="quantity unit_price amount"))
def label_refunds_and_repair(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).where("is_refund or _repaired").select("transaction_id", "quantity", "unit_price", "amount", "is_refund", F.col("_repaired").alias("repaired"), F.col("_reject_reason").alias("reason"))


@query(sql.with_(sql.RAW, "SELECT DISTINCT * FROM raw"))
def drop_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.drop_exact_duplicates(raw(spark, d))


@query(_g("SELECT transaction_id, loyalty_id, id_rank FROM ranked WHERE id_rank > 1", longs="id_rank"))
def quarantine_conflicting_ids(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.mark_conflicting_ids(cleaning.drop_exact_duplicates(raw(spark, d))).where("id_rank > 1").select("transaction_id", "loyalty_id", "id_rank")


@query(_g("SELECT category, q1, q3, lower, upper FROM bounds", doubles="q1 q3 lower upper"))
def iqr_bounds(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.iqr_bounds(cleaning.survivors(gated(spark, d)))


@query(_g("SELECT transaction_id, category, amount FROM clean WHERE is_stat_outlier", doubles="amount"))
def flag_stat_outliers(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d).where("is_stat_outlier").select("transaction_id", "category", "amount")


@query(_g(_CLEAN))
def clean_transactions(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d).select(*CLEAN_COLUMNS)


@query(_g("SELECT count(*) AS n, strftime(min(ts_utc), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts_utc), '%Y-%m-%d %H:%M:%S') AS last_ts, true AS in_order FROM clean"))
def clean_time_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The clean table written in time order: within a part each row is at least the one before, and parts don't overlap."""
    path = scratch(spark)
    rows = clean(spark, d)
    cleaning.finalize(rows, sort=True).select("ts_utc", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")).write.parquet(path)
    rows = spark.read.parquet(path)
    before = F.lag("ts_utc").over(Window.partitionBy("part").orderBy("i"))
    parts = rows.withColumn("ok", F.coalesce(before <= F.col("ts_utc"), F.lit(True))).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ts_utc").alias("a"), F.max("ts_utc").alias("b"), F.bool_and("ok").alias("ok"))
    parts = parts.withColumn("ok", F.col("ok") & F.coalesce(F.lag("b").over(Window.orderBy("part")) <= F.col("a"), F.lit(True)))
    return parts.agg(F.sum("n").alias("n"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), F.bool_and("ok").alias("in_order"))


@query(_g("SELECT reason, count(*) AS n FROM gated WHERE reason IS NOT NULL GROUP BY reason"))
def quarantine_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.quarantine_breakdown(gated(spark, d))


@query(
    _g(
        """SELECT step, stage, n AS rows, 100.0 * n / (SELECT count(*) FROM raw) AS kept_pct FROM (
  SELECT step, stage, CASE WHEN stage = 'raw' THEN (SELECT count(*) FROM raw) WHEN stage = 'quarantined' THEN (SELECT count(*) FROM gated WHERE reason IS NOT NULL) ELSE (SELECT count(*) FROM gated AS g LEFT JOIN gates AS t ON g.reason = t.reason WHERE t.gate IS NULL OR t.gate > upto) END AS n
  FROM (VALUES (0, 'raw', 0), (1, 'dedupe', 1), (2, 'strings', 2), (3, 'types', 2), (4, 'timestamps', 4), (5, 'referential', 6), (6, 'business_rules', 10), (7, 'outliers', 11), (8, 'final_clean', 11), (9, 'quarantined', -1)) AS v(step, stage, upto)) AS f""",
        longs="step rows",
    ).replace("CAST(step AS BIGINT) AS step", "round(kept_pct, 4) AS kept_pct, CAST(step AS BIGINT) AS step")
)
def quality_funnel(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.quality_funnel(raw(spark, d), gated(spark, d))


_ALIVE = "SELECT g.*, coalesce(t.gate, 99) AS gate FROM gated AS g LEFT JOIN gates AS t ON g.reason = t.reason"
_COUNTERS = f"""SELECT (SELECT count(*) FROM raw) - count(*) AS exact_duplicates, count(*) FILTER (gate > 2 AND payment_type = 'other') AS payments_other,
  count(*) FILTER (gate > 2 AND text_quantity IS NOT NULL AND quantity IS NULL) AS bad_quantity, count(*) FILTER (gate > 2 AND text_unit_price IS NOT NULL AND unit_price IS NULL) AS bad_unit_price, count(*) FILTER (gate > 2 AND text_amount IS NOT NULL AND amount0 IS NULL) AS bad_amount,
  count(*) FILTER (gate > 6 AND is_refund) AS refunds, count(*) FILTER (gate > 8 AND repaired) AS repaired, (SELECT count(*) FROM clean WHERE is_stat_outlier) AS stat_outliers FROM ({_ALIVE}) AS a"""


@query(_g(_COUNTERS))
def quality_counters(spark: SparkSession, d: str) -> DataFrame:
    g = kept(gated(spark, d))
    rows = cleaning.survivors(g)
    return cleaning.quality_counters(raw(spark, d), g, cleaning.flag_stat_outliers(rows, cleaning.iqr_bounds(rows)))


@query(
    _g(
        f"""SELECT l.name, l.injected, CASE l.name WHEN 'refunds' THEN c.refunds WHEN 'duplicates' THEN c.exact_duplicates + (SELECT count(*) FROM gated WHERE reason = 'duplicate_transaction_id')
  WHEN 'orphan_store' THEN (SELECT count(*) FROM gated WHERE reason = 'orphan_store_id_not_in_dimension') WHEN 'zero_quantity' THEN (SELECT count(*) FROM gated WHERE reason = 'zero_quantity')
  ELSE (SELECT count(*) FROM gated WHERE reason = 'amount_quantity_price_mismatch') END AS caught
FROM (SELECT name, injected FROM (UNPIVOT ({adapters.LEDGER}) ON COLUMNS(*) INTO NAME name VALUE injected)) AS l CROSS JOIN ({_COUNTERS}) AS c""",
        longs="caught",
    )
)
def reconcile_ledger(spark: SparkSession, d: str) -> DataFrame:
    g = kept(gated(spark, d))
    rows = cleaning.survivors(g)
    counters = cleaning.quality_counters(raw(spark, d), g, cleaning.flag_stat_outliers(rows, cleaning.iqr_bounds(rows)))
    wide = adapters.adapt(spark, d, adapters.LEDGER)
    return cleaning.reconcile_ledger(wide.unpivot([], wide.columns, "name", "injected"), counters, cleaning.quarantine_breakdown(g))
