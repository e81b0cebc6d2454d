from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import text, time
from shelfcast.operators import cleaning
from shelfcast.schemas import RAW, CleaningRules
from shelfcast.sources import io

NY = "America/New_York"
BASE = {"transaction_id": "T", "store_id": "S1", "product": "diesel", "category": "fuel", "quantity": "10", "unit_price": "2.50", "amount": "25.00", "payment_type": "cash", "loyalty_id": None, "transaction_ts": "2024-07-04T18:30:00Z"}


def test_rows_without_id_are_spread(spark):
    rows = spark.range(20_000).select(*[F.lit("x").alias(f.name) if f.name not in ("transaction_id", "amount") else F.when(F.lit(f.name == "amount") | (F.col("id") % 4 == 0), F.col("id").cast("string")).alias(f.name) for f in RAW])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranked = cleaning._ranked(cleaning._dealt(rows).dropDuplicates(), rows, None)
    sizes = [r["count"] for r in ranked.where("transaction_id is null").groupBy(F.spark_partition_id()).count().collect()]
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 15_000 and max(sizes) < 2_500 and ranked.where("transaction_id is null and id_rank = 1").count() == 1
    executed = ranked._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1, plan


def gated(spark, *changes):
    rows = [tuple((BASE | {"transaction_id": f"T{i}"} | c)[f.name] for f in RAW) for i, c in enumerate(changes)]
    stores = spark.createDataFrame([("S1", "urban", NY, 1.0), ("S2", "urban", "America/Los_Angeles", 1.0)], "store_id string, store_type string, timezone string, volume_multiplier double")
    return cleaning.gate(io.validate_schema(spark.createDataFrame(rows, RAW)), stores, CleaningRules())


def reasons(spark, *changes):
    out = gated(spark, *changes).select("transaction_id", "_reject_reason").collect()
    return [r["_reject_reason"] for r in sorted(out, key=lambda r: int(r["transaction_id"][1:]))]


def test_gates_in_order(spark):
    got = reasons(
        spark, {}, {"product": "mystery"}, {"product": None}, {"transaction_ts": "not a date"}, {"transaction_ts": "2031-01-01T00:00:00Z"}, {"store_id": None}, {"store_id": None, "transaction_ts": "2024-07-04 13:30:00"},
        {"store_id": "S9"}, {"quantity": "-10"}, {"quantity": "-10", "amount": "-25.00"}, {"quantity": "0", "amount": "0"}, {"quantity": "", "amount": ""}, {"amount": "N/A"}, {"amount": "25.02"}, {"amount": "25.03"}, {"unit_price": ""},
        {"quantity": "60", "amount": "150.00"}, {"quantity": "61", "amount": "152.50"}, {"quantity": "-800", "amount": "-2000.00"}, {"category": " Merchandise ", "unit_price": "101", "quantity": "1", "amount": "101"}, {"amount": "-0.01", "quantity": ""},
    )
    assert got == [
        None, "unmappable_product_label", None, "unparseable_timestamp", "timestamp_out_of_range", "null_store_id", "unparseable_timestamp", "orphan_store_id_not_in_dimension", "inconsistent_sign_amount_vs_quantity", None, "zero_quantity",
        "null_amount_unrepairable", None, None, "amount_quantity_price_mismatch", None, None, "outlier_exceeds_physical_bound", None, "outlier_exceeds_physical_bound", None,
    ]


def test_repair_keeps_refund_label_of_before(spark):
    row = gated(spark, {"quantity": "-4", "amount": ""}).first()
    assert row["amount"] == -10.0 and row["is_refund"] is False and row["_reject_reason"] is None


def test_duplicates_and_null_ids(spark):
    rows = [{}, {"transaction_id": "T0"}, {"transaction_id": "T0", "loyalty_id": "LX"}, {"transaction_id": None}, {"transaction_id": None, "amount": "25.01"}]
    got = gated(spark, *rows).groupBy("_reject_reason").count().collect()
    assert {r[0]: r[1] for r in got} == {None: 2, "duplicate_transaction_id": 2}


@pytest.mark.parametrize(
    ("wall", "zone", "want"),
    [("2024-03-10 02:30:00", NY, "2024-03-10 07:00:00"), ("2024-11-03 01:30:00", NY, None), ("2024-11-03 00:59:00", NY, "2024-11-03 04:59:00"), ("2024-03-10 02:30:00", "America/Los_Angeles", "2024-03-10 10:00:00"), ("2024-07-01 12:00:00", "America/Denver", "2024-07-01 18:00:00")],
)
def test_clock_changes(spark, wall, zone, want):
    got = spark.range(1).select(F.date_format(time.to_utc(F.lit(wall).cast("timestamp"), F.lit(zone)), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == want


def test_business_day_is_local(spark):
    row = gated(spark, {"store_id": "S2", "transaction_ts": "2024-02-01T07:00:00Z"}).first()
    assert str(row["business_date"]) == "2024-01-31" and row["ts_local"] == "2024-01-31 23:00:00-0800" and row["ts_utc"] == datetime(2024, 2, 1, 7)


def test_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ("N/A", "nan", "1d", " 12.5 ", "1e3", "", "1,000", "-.5", None)], "x string")
    assert [r[0] for r in rows.select(text.to_number(F.col("x"))).collect()] == [None, None, None, 12.5, 1000.0, None, None, -0.5, None]


def test_labels(spark):
    rows = spark.createDataFrame([("\t Regular  UNLEADED ",), ("Car Wash",), (None,), ("x",)], "x string")
    assert [r[0] for r in rows.select(cleaning.normalize_product(F.col("x"))).collect()] == ["regular_unleaded", "car_wash", None, None]
    assert [r[0] for r in rows.select(cleaning.normalize_payment(F.when(F.col("x").isNotNull(), " CASH "))).collect()] == ["cash", "cash", "other", "cash"]


def test_outliers_strictly_outside(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 7)] + [("b", 5.0), (None, 1.0), (None, 1.0)], "category string, amount double")
    bounds = cleaning.iqr_bounds(rows)
    assert {r["category"]: r["upper"] for r in bounds.collect()} == {"a": 7.0, "b": 5.0, None: 1.0}
    more = rows.union(spark.createDataFrame([("a", -7.01)], rows.schema))
    assert [r["amount"] for r in cleaning.flag_stat_outliers(more, bounds).where("is_stat_outlier").collect()] == [-7.01]


def test_conservation_and_tables(spark):
    changes = [{}, {"transaction_id": "T0"}, {"product": "mystery"}, {"store_id": "S9"}, {"quantity": "0"}, {"payment_type": None}]
    g = gated(spark, *changes)
    raw = spark.createDataFrame([tuple((BASE | {"transaction_id": f"T{i}"} | c)[f.name] for f in RAW) for i, c in enumerate(changes)], RAW)
    rows = cleaning.survivors(g)
    flagged = cleaning.flag_stat_outliers(rows, cleaning.iqr_bounds(rows))
    counters = cleaning.quality_counters(raw, g, flagged).first()
    assert raw.count() == cleaning.finalize(flagged).count() + cleaning.quarantine(g).count() + counters["exact_duplicates"]
    assert counters["payments_other"] == 1
    assert [r["rows"] for r in cleaning.quality_funnel(raw, g).orderBy("step").collect()] == [6, 5, 4, 4, 4, 3, 2, 2, 2, 3]
    ledger = spark.createDataFrame([("duplicates", 1), ("zero_quantity", 1), ("unknown", 5)], "name string, injected long")
    got = cleaning.reconcile_ledger(ledger, cleaning.quality_counters(raw, g, flagged), cleaning.quarantine_breakdown(g)).collect()
    assert {r["name"]: r["caught"] for r in got} == {"duplicates": 1, "zero_quantity": 1}


def test_schema_and_files(spark, tmp_path):
    with pytest.raises(ValueError, match="amount"):
        io.validate_schema(spark.range(1).select(*[F.lit("x").alias(f.name) for f in RAW if f.name != "amount"]))
    assert io.read_ledger(spark, f"{tmp_path}/none.json") is None
    (tmp_path / "ledger.json").write_text('{"refunds": 3, "duplicates": 4}')
    assert {tuple(r) for r in io.read_ledger(spark, f"{tmp_path}/ledger.json").collect()} == {("refunds", 3), ("duplicates", 4)}
    assert not io.write_quarantine(cleaning.quarantine(gated(spark, {})), f"{tmp_path}/q")
