"""Drift monitoring as queries: the 28-day mean stands in for predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import monitor
from shelfcast.plans import adapters, sql
from shelfcast.plans.cleaning_queries import stores
from shelfcast.plans.forecast_queries import predicted, steps
from shelfcast.plans.feature_queries import matrix
from shelfcast.plans.registry import query
from shelfcast.session import kept

VAL_START, REFERENCE_END, CHANGE = "2000-09-01", "2000-12-31", "2001-05-15"


def _steps() -> dict[str, str]:
    out = steps() | {
        "stores": adapters.STORES,
        "scored": f"SELECT p.* EXCLUDE (naive), mean28 AS p, store_type, CASE WHEN business_date < DATE '{VAL_START}' THEN 'train' WHEN business_date <= DATE '{REFERENCE_END}' THEN 'reference' ELSE 'production' END AS period FROM pred AS p LEFT JOIN stores AS s ON p.store_id = s.store_id",
        "changed": f"SELECT * REPLACE (CASE WHEN store_type = 'highway' AND business_date >= DATE '{CHANGE}' THEN demand * 0.65 ELSE demand END AS demand) FROM scored",
    }
    for rows, name in (("scored", "healthy"), ("changed", "drifted")):
        weekly = "CAST(date_trunc('week', business_date) AS DATE) AS week, sum(abs(demand - p)) / nullif(sum(abs(demand)), 0) AS wape, count(*) AS n"
        out[f"{name}_weekly"] = f"SELECT {weekly} FROM {rows} WHERE period = 'production' GROUP BY 1"
        out[f"{name}_segments"] = f"SELECT store_type, {weekly} FROM {rows} WHERE period = 'production' GROUP BY 1, 2"
        out[f"{name}_long"] = " UNION ALL ".join([f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, period = 'train' AS r, period = 'production' AS c FROM {rows}" for f in (*monitor.INPUTS, "demand")] + [f"SELECT 'pred', CAST(p AS DOUBLE), period = 'reference', period = 'production' FROM {rows}"])
        out[f"{name}_edges"] = f"SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM {name}_long WHERE r AND x IS NOT NULL GROUP BY feature"
        out[f"{name}_bins"] = f"SELECT l.feature, len(list_filter(e, lambda v: round(v, 9) <= round(x, 9))) AS bin, count(*) FILTER (r) AS nr, count(*) FILTER (c) AS nc FROM {name}_long AS l JOIN {name}_edges AS g ON l.feature = g.feature WHERE x IS NOT NULL GROUP BY 1, 2"
        out[f"{name}_psi"] = f"""SELECT feature, CASE WHEN any_value(tr) >= 10 AND any_value(tc) >= 10 THEN sum((fc - fr) * ln(fc / fr)) END AS psi FROM (
          SELECT f.feature, tr, tc, greatest(coalesce(nr, 0) / CAST(tr AS DOUBLE), 1e-6) AS fr, greatest(coalesce(nc, 0) / CAST(tc AS DOUBLE), 1e-6) AS fc
          FROM (SELECT feature, sum(nr) AS tr, sum(nc) AS tc FROM {name}_bins GROUP BY feature) AS f CROSS JOIN range(0, 10) AS k(b) LEFT JOIN {name}_bins AS n ON n.feature = f.feature AND n.bin = b) AS z GROUP BY feature"""
        out[f"{name}_limit"] = "SELECT median(wape) * 1.05 AS threshold FROM healthy_weekly"
        out[f"{name}_run"] = f"SELECT coalesce(max(n), 0) AS max_run FROM (SELECT count(*) AS n FROM (SELECT bad, row_number() OVER (ORDER BY week) - row_number() OVER (PARTITION BY bad ORDER BY week) AS island FROM (SELECT week, coalesce(wape > threshold, false) AS bad FROM {name}_weekly, {name}_limit) AS w) AS i WHERE bad GROUP BY island) AS r"
        out[f"{name}_decision"] = f"""SELECT threshold, max_run, max_run >= 2 OR len(d) > 0 OR t AS retrain, concat_ws('; ', CASE WHEN max_run >= 2 THEN 'sustained degradation' END, CASE WHEN len(d) > 0 THEN concat('input drift: ', array_to_string(d, ',')) END, CASE WHEN t THEN 'target drift' END) AS reasons
          FROM {name}_limit, {name}_run, (SELECT coalesce(list(feature ORDER BY feature) FILTER (psi > 0.2 AND feature NOT IN ('demand', 'pred')), []) AS d, coalesce(bool_or(psi > 0.2) FILTER (feature = 'demand'), false) AS t FROM {name}_psi) AS x"""
    return out


_STEPS = _steps()


def _m(final: str, **types: str) -> str:
    return sql.shown(sql.with_(_STEPS, final), **types)


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = monitor.attach_store_type(predicted(spark, d).withColumnRenamed("mean28", "pred"), stores(spark, d))
    return monitor.split_reference_production(rows, VAL_START, REFERENCE_END)


def changed(spark: SparkSession, d: str) -> DataFrame:
    return monitor.inject_regime_change(scored(spark, d), CHANGE)


def production(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where("period = 'production'")


@query(_m("SELECT store_type, period, count(*) AS n, min(business_date) AS first_day, max(business_date) AS last_day FROM scored GROUP BY 1, 2", dates="first_day last_day"))
def split_reference_production(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("store_type", "period").agg(F.count(F.lit(1)).alias("n"), F.min("business_date").alias("first_day"), F.max("business_date").alias("last_day"))


@query(_m("SELECT store_type, period, sum(demand) AS demand FROM changed GROUP BY 1, 2", doubles="demand"))
def inject_regime_change(spark: SparkSession, d: str) -> DataFrame:
    return changed(spark, d).groupBy("store_type", "period").agg(F.sum("demand").alias("demand"))


@query(_m("SELECT * FROM healthy_weekly", doubles="wape", dates="week"))
def weekly_wape(spark: SparkSession, d: str) -> DataFrame:
    return monitor.weekly_wape(production(spark, d))


@query(_m("SELECT * FROM healthy_segments", doubles="wape", dates="week"))
def weekly_segment_wape(spark: SparkSession, d: str) -> DataFrame:
    return monitor.weekly_wape(production(spark, d), "store_type")


@query(_m("SELECT store_type, avg(wape) AS mean_wape FROM healthy_segments GROUP BY store_type", doubles="mean_wape"))
def segment_health(spark: SparkSession, d: str) -> DataFrame:
    return monitor.segment_health(monitor.weekly_wape(production(spark, d), "store_type"))


@query(_m("SELECT median(wape) AS operating_wape FROM healthy_weekly", doubles="operating_wape"))
def operating_wape(spark: SparkSession, d: str) -> DataFrame:
    return monitor.operating_wape(monitor.weekly_wape(production(spark, d)))


@query(_m("SELECT max_run FROM healthy_run"))
def max_consecutive_degraded(spark: SparkSession, d: str) -> DataFrame:
    weekly = monitor.weekly_wape(production(spark, d))
    limit = monitor.operating_wape(weekly).select((F.col("operating_wape") * 1.05).alias("threshold"))
    return monitor.max_consecutive_degraded(weekly.crossJoin(F.broadcast(limit)), F.col("threshold"))


@query(_m("SELECT feature, psi, CASE WHEN psi IS NULL THEN 'n/a' WHEN psi > 0.2 THEN 'SIGNIFICANT' WHEN psi > 0.1 THEN 'moderate' ELSE 'stable' END AS label FROM healthy_psi WHERE feature NOT IN ('demand', 'pred')", doubles="psi"))
def input_drift(spark: SparkSession, d: str) -> DataFrame:
    return monitor.input_drift(kept(scored(spark, d))).withColumn("label", monitor.psi_label(F.col("psi")))


@query(_m("SELECT feature, psi FROM healthy_psi WHERE feature = 'demand'", doubles="psi"))
def target_drift(spark: SparkSession, d: str) -> DataFrame:
    return monitor.target_drift(kept(scored(spark, d)))


@query(_m("SELECT feature, psi FROM healthy_psi WHERE feature = 'pred'", doubles="psi"))
def prediction_drift(spark: SparkSession, d: str) -> DataFrame:
    return monitor.prediction_drift(kept(scored(spark, d)))


@query(_m("SELECT * FROM healthy_decision", doubles="threshold"))
def retrain_decision_healthy(spark: SparkSession, d: str) -> DataFrame:
    return monitor.monitor(kept(scored(spark, d)))["decision"]


@query(_m("SELECT * FROM drifted_decision", doubles="threshold"))
def retrain_decision_drifted(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(scored(spark, d))
    healthy = monitor.operating_wape(monitor.weekly_wape(rows.where("period = 'production'")))
    return monitor.monitor(monitor.inject_regime_change(rows, CHANGE), healthy)["decision"]


def trained(spark: SparkSession, d: str) -> DataFrame:
    """The matrix with store types, periods and the predictions of a model that was frozen before production, stored."""
    rows = monitor.attach_store_type(matrix(spark, d), stores(spark, d))
    return kept(monitor.score_periods(kept(monitor.split_reference_production(rows, VAL_START, REFERENCE_END), "periods")), "scored")


def both_passes(rows: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """The tables of a monitoring pass, healthy and after a change of demand that the model doesn't see."""
    healthy = monitor.operating_wape(monitor.weekly_wape(rows.where("period = 'production'")))
    return {name: monitor.monitor(of, healthy) for name, of in (("healthy", rows), ("drifted", monitor.inject_regime_change(rows, CHANGE)))}


@query()
def monitor_trained(spark: SparkSession, d: str) -> DataFrame:
    """All tables of both passes over a trained model's predictions: `kind` says which, `name` the week, segment or feature, `value` its WAPE or PSI, `note` whether the week is degraded, the label of the PSI or the reasons of the decision."""
    out = []
    for name, tables in both_passes(trained(spark, d)).items():
        rows = [tables["weekly"].select(F.lit("week").alias("kind"), F.col("week").cast("string").alias("name"), F.col("wape").alias("value"), F.when(F.col("degraded"), "degraded").otherwise("").alias("note"))]
        rows.append(tables["segments"].select(F.lit("segment"), "store_type", "mean_wape", F.lit("")))
        rows += [tables[t].select(F.lit(t), "feature", "psi", monitor.psi_label(F.col("psi"))) for t in ("inputs", "target", "predictions")]
        rows.append(tables["decision"].select(F.lit("decision"), F.when(F.col("retrain"), "retrain").otherwise("keep"), F.col("max_run").cast("double"), "reasons"))
        out += [r.select(F.lit(name).alias("pass"), "*") for r in rows]
    return reduce(DataFrame.union, out)


@query(_m("SELECT week, wape, n, coalesce(wape > threshold, false) AS degraded FROM drifted_weekly, drifted_limit", doubles="wape", dates="week"))
def monitor_weekly(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(scored(spark, d))
    healthy = monitor.operating_wape(monitor.weekly_wape(rows.where("period = 'production'")))
    return monitor.monitor(monitor.inject_regime_change(rows, CHANGE), healthy)["weekly"]
