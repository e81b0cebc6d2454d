"""From raw transactions to clean rows, a quarantine and the numbers of the quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions import text, time
from shelfcast.functions.joins import small
from shelfcast.schemas import CLEAN_COLUMNS, GATES, PAYMENT_TYPES, RAW_COLUMNS, CleaningRules

_NULL_ID_SALTS = 64
_SALT = "_salt"


def _dealt(raw: DataFrame) -> DataFrame:
    """Rows dealt by transaction_id, and those without one by a hash of all their columns too, so that they are spread over _NULL_ID_SALTS places."""
    salt = F.when(F.col("transaction_id").isNull(), F.pmod(F.xxhash64(*raw.columns), F.lit(_NULL_ID_SALTS))).otherwise(F.lit(0))
    return raw.withColumn(_SALT, salt.cast("int")).repartition("transaction_id", _SALT)


def _ranked(dealt: DataFrame, raw: DataFrame, order_by: list[str] | None) -> DataFrame:
    """dealt rows with id_rank. The first of all rows without id comes from an aggregate of those raw rows alone: one row, known before the ranking."""
    columns = order_by or sorted(raw.columns)
    place = F.row_number().over(Window.partitionBy("transaction_id", _SALT).orderBy(*[F.col(c).asc_nulls_first() for c in columns]))
    first = raw.where("transaction_id is null").agg(F.min(F.struct(*columns)).alias("_first"))
    late = F.col("transaction_id").isNull() & ~F.struct(*columns).eqNullSafe(F.col("_first"))
    ranked = dealt.withColumn("id_rank", place).crossJoin(F.broadcast(first))
    return ranked.withColumn("id_rank", F.when(late, F.col("id_rank") + 1).otherwise(F.col("id_rank"))).drop(_SALT, "_first")


def drop_exact_duplicates(raw: DataFrame) -> DataFrame:
    """Distinct rows, nulls equal."""
    return _dealt(raw).dropDuplicates().drop(_SALT)


def mark_conflicting_ids(raw: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """`id_rank`: 1 for the row kept of each transaction_id, more for its conflicting copies.

    Spark keeps no file order, so the first row is the least by `order_by` (all columns). Null ids count as one id.
    """
    return _ranked(_dealt(raw), raw, order_by)


def normalize_product(c: Column, rules: CleaningRules = CleaningRules()) -> Column:
    return text.lookup(text.squash(c), rules.products)


def normalize_payment(c: Column) -> Column:
    low = F.lower(text.strip(c))
    return F.when(F.coalesce(low.isin(*PAYMENT_TYPES), F.lit(False)), low).otherwise("other")


def normalize_category(c: Column) -> Column:
    return F.lower(text.strip(c))


def attach_store_timezone(raw: DataFrame, stores: DataFrame) -> DataFrame:
    """Each row with its store's zone and whether the store is known. The dimension has a row a store and is broadcast if it is small."""
    dim = stores.select("store_id", F.col("timezone").alias("_zone"), F.lit(True).alias("_known"))
    return raw.join(small(dim), "store_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))


def _true(c: Column) -> Column:
    """A comparison with null counts as false, so every row falls on one side of a gate."""
    return F.coalesce(c, F.lit(False))


def gate(raw: DataFrame, stores: DataFrame, rules: CleaningRules = CleaningRules(), order_by: list[str] | None = None) -> DataFrame:
    """Every distinct row with its derived columns and `_reject_reason`: the first gate that it fails, or null.

    Exact duplicates and the id gate share one exchange; all other gates look at the row and its store alone and are one projection above it.
    """
    rows = _ranked(_dealt(raw).dropDuplicates(), raw, order_by)
    rows = attach_store_timezone(rows, stores)
    rows = rows.withColumn("product_raw", F.col("product")).withColumn("product", normalize_product(F.col("product_raw"), rules))
    rows = rows.withColumn("payment_type", normalize_payment(F.col("payment_type"))).withColumn("category", normalize_category(F.col("category")))
    for c in ("quantity", "unit_price", "amount"):
        rows = rows.withColumn(f"_text_{c}", F.col(c)).withColumn(c, text.to_number(F.col(c)))
    rows = rows.withColumn("_ts", text.strip(F.col("transaction_ts")))
    instant, wall = time.parse(F.col("_ts"))
    rows = rows.withColumn("_instant", instant).withColumn("_wall", wall)
    rows = rows.withColumn("ts_utc", F.coalesce("_instant", time.to_utc(F.col("_wall"), F.col("_zone"))))
    rows = rows.withColumn("ts_local", time.local_text(F.col("ts_utc"), F.col("_zone")))
    rows = rows.withColumn("business_date", F.to_date(F.from_utc_timestamp("ts_utc", F.col("_zone"))))
    q, p, a = F.col("quantity"), F.col("unit_price"), F.col("amount")
    rows = rows.withColumn("is_refund", _true((a < 0) & (q < 0))).withColumn("_mixed_signs", _true((a < 0) != (q < 0)))
    rows = rows.withColumn("_repaired", a.isNull() & q.isNotNull() & p.isNotNull()).withColumn("amount", F.coalesce(a, text.cents(q * p)))
    fuel = F.col("category") == "fuel"
    bound = _true(fuel & (F.abs(q) > rules.fuel_quantity)) | _true(fuel & (F.abs(p) > rules.fuel_price))
    goods = F.col("category") == "merchandise"
    bound = bound | _true(goods & (F.abs(p) > rules.goods_price)) | _true(goods & (F.abs(q) > rules.goods_quantity))
    failed = (
        F.col("id_rank") > 1,
        F.col("product_raw").isNotNull() & F.col("product").isNull(),
        F.col("ts_utc").isNull(),
        ~F.col("ts_utc").between(F.lit(rules.earliest).cast("timestamp"), F.lit(rules.latest).cast("timestamp")),
        F.col("store_id").isNull(),
        ~F.col("_known"),
        F.col("_mixed_signs"),
        _true(q == 0),
        F.col("amount").isNull(),
        _true(F.abs(F.abs(F.col("amount")) - text.cents(F.abs(q * p))) > rules.tolerance),
        ~F.col("is_refund") & bound,
    )
    reason = F.lit(None).cast("string")
    for name, test in reversed(list(zip(GATES, failed, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    return rows.withColumn("_reject_reason", reason).drop("_ts", "_instant", "_wall")


def survivors(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("_reject_reason").isNull())


def quarantine(gated: DataFrame) -> DataFrame:
    """Rejected rows as they came, with the raw label and the reason."""
    raw = [F.col(f"_text_{c}").alias(c) if c in ("quantity", "unit_price", "amount") else F.col(c) for c in RAW_COLUMNS]
    return gated.where(F.col("_reject_reason").isNotNull()).select(*raw, "product_raw", "_reject_reason")


def iqr_bounds(rows: DataFrame, accuracy: int | None = None) -> DataFrame:
    """category, q1, q3, lower, upper of abs(amount); a null category is a group. With `accuracy`, approximate percentiles.

    Exact ones are taken from counts by value: amounts are cents within the physical bounds, so a category has no more values than those allow.
    """
    rows = rows.select("category", F.abs("amount").alias("_size"))
    if accuracy is None:
        values = rows.groupBy("category", "_size").agg(F.count(F.lit(1)).alias("_n"))
        q = values.groupBy("category").agg(F.percentile("_size", F.array(F.lit(0.25), F.lit(0.75)), F.col("_n")).alias("q"))
    else:
        q = rows.groupBy("category").agg(F.percentile_approx("_size", [0.25, 0.75], accuracy).alias("q"))
    out = q.select("category", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    span = 1.5 * (F.col("q3") - F.col("q1"))
    return out.select("category", "q1", "q3", F.round(F.col("q1") - span, 9).alias("lower"), F.round(F.col("q3") + span, 9).alias("upper"))


def flag_stat_outliers(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """is_stat_outlier: abs(amount) strictly outside its category's bounds. Bounds have a row a category and are broadcast."""
    b = bounds.select(F.col("category").alias("_category"), "lower", "upper")
    joined = rows.join(F.broadcast(b), F.col("category").eqNullSafe(F.col("_category")), "left")
    size = F.abs("amount")
    return joined.withColumn("is_stat_outlier", _true((size < F.col("lower")) | (size > F.col("upper")))).drop("_category", "lower", "upper")


def finalize(rows: DataFrame, sort: bool = False) -> DataFrame:
    """The clean columns. A global time sort is optional; writers sort within a date instead."""
    out = rows.select(*CLEAN_COLUMNS)
    return out.orderBy("ts_utc") if sort else out


def quarantine_breakdown(gated: DataFrame) -> DataFrame:
    rejected = gated.where(F.col("_reject_reason").isNotNull())
    return rejected.groupBy(F.col("_reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def quality_funnel(raw: DataFrame, gated: DataFrame) -> DataFrame:
    """Rows left after each stage, then rows in quarantine, each with its share of raw rows. One count by reason; stages are running differences in gate order."""
    spark = raw.sparkSession
    stages = [("raw", 0), ("dedupe", 1), ("strings", 2), ("types", 2), ("timestamps", 4), ("referential", 6), ("business_rules", 10), ("outliers", 11), ("final_clean", 11), ("quarantined", -1)]
    gates = F.broadcast(spark.createDataFrame([(g, i + 1) for i, g in enumerate(GATES)], "reason string, gate int"))
    lost = gated.groupBy(F.col("_reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n")).join(gates, "reason", "left")
    total = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    plan = spark.createDataFrame([(i, s, g) for i, (s, g) in enumerate(stages)], "step int, stage string, upto int")
    here = F.when(F.col("upto") < 0, F.col("gate").isNotNull()).otherwise(F.col("gate").isNull() | (F.col("gate") > F.col("upto")))
    left = F.sum(F.when(here, F.col("n")).otherwise(0))
    out = F.broadcast(plan).crossJoin(lost).groupBy("step", "stage").agg(left.alias("left")).crossJoin(F.broadcast(total))
    rows = F.when(F.col("stage") == "raw", F.col("raw_rows")).otherwise(F.col("left")).cast("long")
    return out.select("step", "stage", rows.alias("rows"), F.round(100.0 * rows / F.col("raw_rows"), 4).alias("kept_pct"))


def quality_counters(raw: DataFrame, gated: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row of counts, each over the rows still alive at its gate."""
    gate_of = F.create_map(*[F.lit(x) for i, g in enumerate(GATES) for x in (g, i + 1)])
    failed = F.coalesce(F.try_element_at(gate_of, F.col("_reject_reason")), F.lit(99))
    alive = lambda upto: failed > upto
    broken = [F.count_if(alive(2) & F.col(f"_text_{c}").isNotNull() & text.to_number(F.col(f"_text_{c}")).isNull()).alias(f"bad_{c}") for c in ("quantity", "unit_price", "amount")]
    counts = gated.agg(
        F.count(F.lit(1)).alias("_distinct"), F.count_if(alive(2) & (F.col("payment_type") == "other")).alias("payments_other"), *broken,
        F.count_if(alive(6) & F.col("is_refund")).alias("refunds"), F.count_if(alive(8) & F.col("_repaired")).alias("repaired"),
    )
    counts = counts.crossJoin(raw.agg(F.count(F.lit(1)).alias("_raw"))).crossJoin(flagged.agg(F.count_if("is_stat_outlier").alias("stat_outliers")))
    return counts.withColumn("exact_duplicates", F.col("_raw") - F.col("_distinct")).drop("_raw", "_distinct")


#: Issue in the ledger, and the counter or reasons that catch it.
LEDGER = {
    "duplicates": ("exact_duplicates", ("duplicate_transaction_id",)),
    "refunds": ("refunds", ()),
    "orphan_store": (None, ("orphan_store_id_not_in_dimension",)),
    "zero_quantity": (None, ("zero_quantity",)),
    "amount_mismatch": (None, ("amount_quantity_price_mismatch",)),
}


def reconcile_ledger(ledger: DataFrame, counters: DataFrame, breakdown: DataFrame) -> DataFrame:
    """name, injected, caught for the issues that the ledger names."""
    spark = ledger.sparkSession
    by_name = counters.unpivot([], ["exact_duplicates", "refunds"], "key", "n").unionByName(breakdown.select(F.col("reason").alias("key"), "n"))
    keys = spark.createDataFrame([(name, key) for name, (counter, reasons) in LEDGER.items() for key in ((counter,) if counter else ()) + reasons], "name string, key string")
    caught = by_name.join(F.broadcast(keys), "key", "right").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("caught"))
    return ledger.join(caught, "name").select("name", "injected", "caught")
