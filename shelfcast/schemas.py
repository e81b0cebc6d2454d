"""Schemas, gate order and default parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Columns of raw and of clean transactions, in order.
RAW_COLUMNS = ("transaction_id", "store_id", "product", "category", "quantity", "unit_price", "amount", "payment_type", "loyalty_id", "transaction_ts")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
STORES = T.StructType([T.StructField(c, T.StringType()) for c in ("store_id", "store_type", "timezone")] + [T.StructField("volume_multiplier", T.DoubleType())])
CLEAN_COLUMNS = ("transaction_id", "store_id", "ts_utc", "ts_local", "business_date", "product", "category", "quantity", "unit_price", "amount", "payment_type", "loyalty_id", "is_refund", "is_stat_outlier")
#: Reject reasons in gate order.
GATES = (
    "duplicate_transaction_id", "unmappable_product_label", "unparseable_timestamp", "timestamp_out_of_range", "null_store_id", "orphan_store_id_not_in_dimension",
    "inconsistent_sign_amount_vs_quantity", "zero_quantity", "null_amount_unrepairable", "amount_quantity_price_mismatch", "outlier_exceeds_physical_bound",
)
#: Spellings of product labels after trimming and lower-casing, and the names they stand for.
PRODUCT_MAP = {
    "regular_unleaded": "regular_unleaded",
    "regular unleaded": "regular_unleaded",
    "reg unleaded": "regular_unleaded",
    "midgrade": "midgrade",
    "mid_grade": "midgrade",
    "mid grade": "midgrade",
    "premium": "premium",
    "diesel": "diesel",
    "beverages": "beverages",
    "beverage": "beverages",
    "snacks": "snacks",
    "snack": "snacks",
    "tobacco": "tobacco",
    "lottery": "lottery",
    "lotto": "lottery",
    "car_wash": "car_wash",
    "car wash": "car_wash",
    "carwash": "car_wash",
}
#: Payment types; others count as "other".
PAYMENT_TYPES = ("credit", "debit", "cash", "mobile")


@dataclass(frozen=True)
class CleaningRules:
    """Parameters of the gates, fixed values by default; time bounds are inclusive and in UTC."""

    earliest: str = "2023-01-01 00:00:00"
    latest: str = "2025-01-02 00:00:00"
    tolerance: float = 0.02
    fuel_quantity: float = 60.0
    fuel_price: float = 8.0
    goods_price: float = 100.0
    goods_quantity: float = 50.0
    products: tuple[tuple[str, str], ...] = tuple(PRODUCT_MAP.items())
