"""Drift monitoring of production forecasts and the retrain decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.errors import wape
from shelfcast.functions.joins import small
from shelfcast.functions.quantiles import exact_quantiles
from shelfcast.operators import forecast, trees
from shelfcast.operators.trees import TreeRules

SIGNIFICANT, MODERATE = 0.2, 0.1
INPUTS = ("demand_lag_7", "demand_rollmean_28", "avg_unit_price", "dow")


@dataclass(frozen=True)
class MonitorRules:
    degrade: float = 1.05
    sustained_weeks: int = 2
    psi: float = SIGNIFICANT


def attach_store_type(rows: DataFrame, stores: DataFrame) -> DataFrame:
    """The segment, for reporting only. The dimension has a row a store and is broadcast if it is small."""
    return rows.join(small(stores.select("store_id", "store_type")), "store_id", "left")


def split_reference_production(rows: DataFrame, val_start: str, reference_end: str) -> DataFrame:
    """rows with `period`: train before val_start, reference up to reference_end, production after."""
    d = F.col("business_date")
    return rows.withColumn("period", F.when(d < F.lit(val_start).cast("date"), "train").when(d <= F.lit(reference_end).cast("date"), "reference").otherwise("production"))


def inject_regime_change(rows: DataFrame, start: str = "2024-11-15", segment: str = "highway", factor: float = 0.65) -> DataFrame:
    """What if demand of a segment drops from a date on? Predictions stay as they are."""
    hit = (F.col("store_type") == segment) & (F.col("business_date") >= F.lit(start).cast("date"))
    return rows.withColumn("demand", F.when(hit, F.col("demand") * factor).otherwise(F.col("demand")))


def weekly_wape(rows: DataFrame, segment: str | None = None) -> DataFrame:
    """WAPE and rows by week (Monday start), with `segment` by segment too."""
    week = F.to_date(F.date_trunc("week", "business_date")).alias("week")
    keys = [F.col(segment), week] if segment else [week]
    return rows.groupBy(*keys).agg(wape(F.col("demand"), F.col("pred")).alias("wape"), F.count(F.lit(1)).alias("n"))


def segment_health(weekly: DataFrame, segment: str = "store_type") -> DataFrame:
    """Unweighted mean over weeks, worst first."""
    return weekly.groupBy(segment).agg(F.avg("wape").alias("mean_wape")).orderBy(F.desc("mean_wape"), segment)


def operating_wape(weekly: DataFrame) -> DataFrame:
    """One row: the median week."""
    return weekly.agg(F.median("wape").alias("operating_wape"))


def max_consecutive_degraded(weekly: DataFrame, threshold: float | Column) -> DataFrame:
    """One row: the longest run of weeks above the threshold. Weekly rows are few, so one window without partition is enough."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    rows = weekly.withColumn("_bad", F.coalesce(F.col("wape") > limit, F.lit(False)))
    island = F.row_number().over(Window.orderBy("week")) - F.row_number().over(Window.partitionBy("_bad").orderBy("week"))
    runs = rows.withColumn("_island", island).where("_bad").groupBy("_island").agg(F.count(F.lit(1)).alias("n"))
    return runs.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_run"))


def population_stability_index(rows: DataFrame, is_reference: Column, is_current: Column, by: str = "feature", value: str = "value") -> DataFrame:
    """PSI of `value` between two sides, for each `by`; null if a side has fewer than 10 values.

    Edges are the reference's deciles, exact for groups of any size (see exact_quantiles); a bin holds its lower edge, repeated edges leave bins empty. The edges have a row for each
    `by`; counts of both sides come from one pass with partial sums.
    """
    side = rows.where(F.col(value).isNotNull()).select(F.col(by), F.col(value).cast("double").alias("_x"), is_reference.alias("_r"), is_current.alias("_c"))
    edges = exact_quantiles(side.where("_r"), by, "_x", tuple(k / 10 for k in range(1, 10))).withColumnRenamed("q", "_edges")
    binned = side.join(F.broadcast(edges), by, "left").withColumn("_bin", F.size(F.filter("_edges", lambda e: F.round(e, 9) <= F.round(F.col("_x"), 9))))
    counts = binned.groupBy(by).agg(*[F.count_if((F.col("_bin") == k) & F.col(s)).alias(f"{s}{k}") for s in ("_r", "_c") for k in range(10)], F.count_if("_r").alias("_nr"), F.count_if("_c").alias("_nc"))
    total = F.lit(0.0)
    for k in range(10):
        r = F.greatest(F.try_divide(F.col(f"_r{k}"), F.col("_nr")), F.lit(1e-6))
        c = F.greatest(F.try_divide(F.col(f"_c{k}"), F.col("_nc")), F.lit(1e-6))
        total = total + (c - r) * F.ln(c / r)
    return counts.select(by, F.when((F.col("_nr") >= 10) & (F.col("_nc") >= 10), total).alias("psi"))


def psi_label(psi: Column) -> Column:
    return F.when(psi.isNull(), "n/a").when(psi > SIGNIFICANT, "SIGNIFICANT").when(psi > MODERATE, "moderate").otherwise("stable")


def input_drift(rows: DataFrame, features: tuple[str, ...] = INPUTS) -> DataFrame:
    """PSI of model inputs, train against production (column `period`)."""
    long = rows.select("period", *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["period"], list(features), "feature", "value")
    return population_stability_index(long, F.col("period") == "train", F.col("period") == "production")


def target_drift(rows: DataFrame) -> DataFrame:
    long = rows.select("period", F.lit("demand").alias("feature"), F.col("demand").alias("value"))
    return population_stability_index(long, F.col("period") == "train", F.col("period") == "production")


def prediction_drift(rows: DataFrame) -> DataFrame:
    """Predictions in the reference block against production."""
    long = rows.select("period", F.lit("pred").alias("feature"), F.col("pred").alias("value"))
    return population_stability_index(long, F.col("period") == "reference", F.col("period") == "production")


def retrain_decision(weekly: DataFrame, operating: DataFrame, inputs: DataFrame, target: DataFrame, rules: MonitorRules = MonitorRules()) -> DataFrame:
    """One row: threshold, longest run above it, whether to retrain and why. Prediction drift never triggers."""
    threshold = operating.select((F.col("operating_wape") * rules.degrade).alias("threshold"))
    run = max_consecutive_degraded(weekly.crossJoin(F.broadcast(threshold)), F.col("threshold"))
    drifted = inputs.agg(F.sort_array(F.collect_list(F.when(F.col("psi") > rules.psi, F.col("feature")))).alias("drifted"))
    moved = target.agg(F.coalesce(F.max("psi") > rules.psi, F.lit(False)).alias("target_drift"))
    row = threshold.crossJoin(F.broadcast(run)).crossJoin(F.broadcast(drifted)).crossJoin(F.broadcast(moved))
    sustained = F.col("max_run") >= rules.sustained_weeks
    reasons = F.concat_ws("; ", F.when(sustained, "sustained degradation"), F.when(F.size("drifted") > 0, F.concat(F.lit("input drift: "), F.array_join("drifted", ","))), F.when(F.col("target_drift"), "target drift"))
    return row.select("threshold", "max_run", (sustained | (F.size("drifted") > 0) | F.col("target_drift")).alias("retrain"), reasons.alias("reasons"))


def score_periods(rows: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """rows (the matrix with `period`) with `pred` of one model for the reference and production periods, null in train: fitted on train, ended by the reference block, then frozen."""
    inputs = forecast.select_model_features([c for c in rows.columns if c not in ("period", "store_type")])
    known = rows.where("period <> 'production'").withColumn("_val", F.col("period") == "reference")
    model = trees.train_global_gbt(known, inputs, "_val", rules)
    ahead = trees.score(model, rows.where("period <> 'train'"))
    return ahead.unionByName(rows.where("period = 'train'").withColumn("pred", F.lit(None).cast("double")))


def monitor(rows: DataFrame, operating: DataFrame | None = None, rules: MonitorRules = MonitorRules()) -> dict[str, DataFrame]:
    """All tables of a monitoring pass over scored rows with `period` and `store_type`. `operating` defaults to the median week of the same production rows."""
    production = rows.where("period = 'production'")
    weekly = weekly_wape(production)
    operating = operating_wape(weekly) if operating is None else operating
    inputs, target = input_drift(rows), target_drift(rows)
    flagged = weekly.crossJoin(F.broadcast(operating)).withColumn("degraded", F.coalesce(F.col("wape") > F.col("operating_wape") * rules.degrade, F.lit(False))).drop("operating_wape")
    return {
        "weekly": flagged, "segments": segment_health(weekly_wape(production, "store_type")), "inputs": inputs, "target": target,
        "predictions": prediction_drift(rows), "decision": retrain_decision(weekly, operating, inputs, target, rules),
    }
