"""Splits, forecasts, scores and backtests as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.errors import clipped
from shelfcast.operators import backtest, forecast, trees
from shelfcast.operators import features as fx
from shelfcast.plans import adapters, sql
from shelfcast.plans.cleaning_queries import scratch
from shelfcast.plans.feature_queries import matrix
from shelfcast.plans.registry import query
from shelfcast.session import kept
from shelfcast.sources import io

METRICS = "wape mae rmse bias"


def steps() -> dict[str, str]:
    """The matrix with split and three simple predictions."""
    return sql.features(adapters.CLEAN) | {
        "last": "SELECT max(business_date) AS d FROM feat",
        "pred": """SELECT feat.*, CASE WHEN business_date >= d - 44 THEN 'test' WHEN business_date >= d - 74 THEN 'val' ELSE 'train' END AS split,
          CASE WHEN demand_lag_7 IS NOT NULL THEN greatest(demand_lag_7, 0) END AS naive, CASE WHEN demand_rollmean_28 IS NOT NULL THEN greatest(demand_rollmean_28, 0) END AS mean28, CASE WHEN demand_rollmean_7 IS NOT NULL THEN greatest(demand_rollmean_7, 0) END AS mean7 FROM feat, last""",
        "folds": "SELECT fold, test_end - 60 AS train_end, test_end - 59 AS val_start, test_end - 30 AS val_end, test_end - 29 AS test_start, test_end FROM (SELECT CAST(i AS BIGINT) AS fold, CAST(d - CAST((5 - i) * 30 AS INT) AS DATE) AS test_end FROM last, range(1, 6) AS r(i)) AS f",
    }


def _p(final: str, **types: str) -> str:
    return sql.shown(sql.with_(steps(), final), **types)


def _metrics(p: str) -> str:
    return f"sum(abs(demand - {p})) / nullif(sum(abs(demand)), 0) AS wape, avg(abs({p} - demand)) AS mae, sqrt(avg(({p} - demand) * ({p} - demand))) AS rmse, avg({p} - demand) AS bias"


def split(spark: SparkSession, d: str) -> DataFrame:
    """The stored matrix with `split`."""
    rows, last_day = fx.keep_matrix(matrix(spark, d))
    return forecast.temporal_split(rows, last_day=last_day)


def with_folds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored matrix and its folds."""
    rows, last_day = fx.keep_matrix(matrix(spark, d))
    return rows, backtest.make_folds(rows, last_day=last_day)


def predicted(spark: SparkSession, d: str) -> DataFrame:
    rows = forecast.seasonal_naive(split(spark, d), "naive")
    return rows.withColumn("mean28", clipped(F.col("demand_rollmean_28"))).withColumn("mean7", clipped(F.col("demand_rollmean_7")))


_LONG = " UNION ALL ".join(f"SELECT '{m}' AS model, demand, {m} AS p FROM pred WHERE split = 'test'" for m in ("naive", "mean28", "mean7"))


@query(_p("SELECT split, count(*) AS n_rows, min(business_date) AS first_day, max(business_date) AS last_day FROM pred GROUP BY split", dates="first_day last_day"))
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return forecast.split_profile(split(spark, d))


@query(_p("SELECT category, count(*) AS n FROM pred WHERE split IN ('train', 'val') GROUP BY category"))
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return forecast.training_rows(split(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_INPUTS = forecast.select_model_features([*fx.DAILY, *fx.CALENDAR, *fx.HISTORY])


@query(_p("SELECT " + ", ".join(_INPUTS) + " FROM pred WHERE split = 'test'", doubles=" ".join(c for c in _INPUTS if c in fx.HISTORY and c != "txn_count_lag_1" or c in ("avg_unit_price", "dow_sin", "dow_cos", "month_sin", "month_cos")), longs=" ".join(c for c in fx.CALENDAR if not c.endswith(("sin", "cos")))))
def select_model_features(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d).where("split = 'test'").select(*_INPUTS)


@query(_p("SELECT store_id, product, business_date, naive AS pred FROM pred WHERE split = 'test'", doubles="pred", dates="business_date"))
def seasonal_naive(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).where("split = 'test'").select("store_id", "product", "business_date", F.col("naive").alias("pred"))


@query(_p(f"SELECT {_metrics('naive')} FROM pred WHERE split = 'test'", doubles=METRICS))
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_metrics(predicted(spark, d).where("split = 'test'"), pred="naive")


@query(_p("SELECT category, sum(abs(demand - naive)) / nullif(sum(abs(demand)), 0) AS wape FROM pred WHERE split = 'test' GROUP BY category", doubles="wape"))
def segment_wape(spark: SparkSession, d: str) -> DataFrame:
    return forecast.segment_wape(predicted(spark, d).where("split = 'test'"), pred="naive")


@query(_p(f"SELECT model, {_metrics('p')} FROM ({_LONG}) AS l GROUP BY model", doubles=METRICS))
def compare_models(spark: SparkSession, d: str) -> DataFrame:
    return forecast.compare_models(predicted(spark, d).where("split = 'test'"), ["naive", "mean28", "mean7"])


@query(_p(f"SELECT model, wape, 100 * ((SELECT wape FROM m WHERE model = 'naive') - wape) / (SELECT wape FROM m WHERE model = 'naive') AS lift_pct, model = (SELECT model FROM m ORDER BY wape, model LIMIT 1) AS is_best FROM m".replace("FROM m", f"FROM (SELECT model, {_metrics('p')} FROM ({_LONG}) AS l GROUP BY model) AS m"), doubles="wape lift_pct"))
def lift_over_baseline(spark: SparkSession, d: str) -> DataFrame:
    return forecast.lift_over_baseline(forecast.compare_models(predicted(spark, d).where("split = 'test'"), ["naive", "mean28", "mean7"]), "naive")


_GRID = """SELECT ROW_NUMBER() OVER (ORDER BY i, j) AS n, i / 10.0::DOUBLE AS a, j / 10.0::DOUBLE AS b, round(1 - i / 10.0::DOUBLE - j / 10.0::DOUBLE, 10) AS c FROM range(0, 11) AS x(i), range(0, 11) AS y(j) WHERE i + j <= 10"""
_TUNED = f"SELECT a AS w_naive, b AS w_mean28, c AS w_mean7, wape FROM (SELECT n, a, b, c, round(sum(abs(demand - (a * naive + b * mean28 + c * mean7))) / nullif(sum(abs(demand)), 0), 9) AS wape FROM (SELECT * FROM pred WHERE split = 'val') AS v, ({_GRID}) AS g GROUP BY n, a, b, c) AS t ORDER BY t.wape, n LIMIT 1"


@query(_p(_TUNED, doubles="w_naive w_mean28 w_mean7 wape"))
def tune_ensemble_weights(spark: SparkSession, d: str) -> DataFrame:
    best = forecast.tune_ensemble_weights(predicted(spark, d).where("split = 'val'"), ["naive", "mean28", "mean7"])
    return best.withColumns({c: best[c].cast("double") for c in best.columns})


@query(_p("SELECT store_id, product, business_date, 0.2 * naive + 0.5 * mean28 + 0.3 * mean7 AS pred FROM pred WHERE split = 'test'", doubles="pred", dates="business_date"))
def blend_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = forecast.blend_predictions(predicted(spark, d).where("split = 'test'"), {"naive": 0.2, "mean28": 0.5, "mean7": 0.3})
    return rows.select("store_id", "product", "business_date", "pred")


@query()
def train_global_gbt(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d)
    known = forecast.training_rows(rows).withColumn("_val", F.col("split") == "val")
    model = trees.train_global_gbt(known, _INPUTS, "_val")
    return forecast.forecast_metrics(trees.score(model, rows.where("split = 'test'")), ["category"])


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    known = forecast.training_rows(predicted(spark, d)).withColumn("_val", F.col("split") == "val")
    return trees.feature_importance(trees.train_global_gbt(known, _INPUTS, "_val"))


_STAND_IN = {"naive": 0.2, "mean28": 0.5, "mean7": 0.3}
_PERMUTED = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, demand, " + " + ".join(f"{w} * {'d_' if m == c else ''}{m}" for m, w in _STAND_IN.items()) + " AS p FROM dealt" for c in ("", *_STAND_IN)
)
_DONORS = "SELECT demand, " + ", ".join(f"{c}, coalesce(lag({c}) OVER w, last_value({c}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS d_{c}" for c in _STAND_IN) + " FROM (SELECT *, md5(concat_ws('/', store_id, product, CAST(business_date AS VARCHAR))) AS h FROM pred WHERE split = 'test') AS t WINDOW w AS (PARTITION BY CAST('0x' || substr(h, 1, 8) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / 100000.0) AS BIGINT)) FROM pred WHERE split = 'test') ORDER BY h)"


@query(_p(f"SELECT feature, wape, wape - (SELECT wape FROM m WHERE feature = '') AS rise FROM m WHERE feature <> ''".replace("FROM m", f"FROM (SELECT feature, sum(abs(demand - p)) / nullif(sum(abs(demand)), 0) AS wape FROM (WITH dealt AS ({_DONORS}) {_PERMUTED}) AS l GROUP BY feature) AS m"), doubles="wape rise"))
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """A fixed blend of three simple forecasts stands in for the model, so that SQL can predict too."""
    rows = predicted(spark, d).where("split = 'test'")
    return forecast.permutation_importance(rows, list(_STAND_IN), lambda r: forecast.blend_predictions(r, _STAND_IN))


@query()
def permutation_importance_trained(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d)
    known = forecast.training_rows(rows).withColumn("_val", F.col("split") == "val")
    model = trees.train_global_gbt(known, _INPUTS, "_val")
    return forecast.permutation_importance(rows.where("split = 'test'"), _INPUTS, lambda r: trees.score(model, r))


@query()
def model_results(spark: SparkSession, d: str) -> DataFrame:
    """All models end to end: fitted on train, weights tuned on val, compared on test; beside the whole test block, the errors of each category."""
    predictions = kept(forecast.predict_all(split(spark, d)), "predictions")
    overall = forecast.model_results(predictions).withColumn("category", F.lit("all"))
    return overall.unionByName(forecast.segment_results(predictions), allowMissingColumns=True)


@query()
def seasonal_decomposition(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(predicted(spark, d))
    test = rows.where("split = 'test'")
    fitted = forecast.seasonal_decomposition_forecast(forecast.training_rows(rows), test)
    both = forecast.fall_back(fitted, test.select("store_id", "product", "business_date", "category", "demand", F.col("naive").alias("pred")))
    return forecast.forecast_metrics(both, ["category"])


_X = ["1.0::DOUBLE", "t / 365.25", *[f"CAST(CASE WHEN isodow(business_date) - 1 = {k} THEN 1 ELSE 0 END AS DOUBLE)" for k in range(1, 7)], *[f"{f}(2 * pi() * {k} * t / 365.25)" for f, k in forecast.WAVES], "CAST(is_holiday AS DOUBLE)"]
_SUMS = ", ".join([*[f"sum(x{i} * x{j}) AS xx_{i}_{j}" for i in range(forecast.WIDTH) for j in range(i, forecast.WIDTH)], *[f"sum(x{i} * demand) AS xy_{i}" for i in range(forecast.WIDTH)]])
_TERMS = [*[f"xx_{i}_{j}" for i in range(forecast.WIDTH) for j in range(i, forecast.WIDTH)], *[f"xy_{i}" for i in range(forecast.WIDTH)]]


@query(_p(f"SELECT store_id, product, count(*) AS n, {_SUMS} FROM (SELECT store_id, product, demand, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(_X)) + " FROM (SELECT *, CAST(date_diff('day', DATE '2000-01-01', business_date) AS DOUBLE) AS t FROM pred WHERE split IN ('train', 'val')) AS p) AS q GROUP BY store_id, product", doubles=" ".join(_TERMS)))
def decomposition_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Everything that the fit of each series sees, a column a sum."""
    sums = forecast.decomposition_statistics(forecast.training_rows(predicted(spark, d)))
    flat = F.concat("xx", "xy")
    return sums.select("store_id", "product", "n", *[flat[i].alias(c) for i, c in enumerate(_TERMS)])


@query(_p("SELECT * FROM folds", dates="train_end val_start val_end test_start test_end", longs="fold"))
def make_folds(spark: SparkSession, d: str) -> DataFrame:
    return with_folds(spark, d)[1]


@query(_p("SELECT fold, CASE WHEN business_date <= train_end THEN 'train' WHEN business_date <= val_end THEN 'val' ELSE 'test' END AS block, count(*) AS n, sum(demand) AS demand FROM pred JOIN folds ON business_date <= test_end GROUP BY 1, 2", doubles="demand", longs="fold"))
def assign_folds(spark: SparkSession, d: str) -> DataFrame:
    return backtest.assign_folds(*with_folds(spark, d)).groupBy("fold", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("demand").alias("demand"))


_BASE = "SELECT fold, count(*) FILTER (business_date <= train_end) AS train_rows, sum(abs(demand - naive)) FILTER (business_date >= test_start) / nullif(sum(abs(demand)) FILTER (business_date >= test_start), 0) AS base_wape, avg(abs(naive - demand)) FILTER (business_date >= test_start) AS base_mae, avg(naive - demand) FILTER (business_date >= test_start) AS base_bias FROM pred JOIN folds ON business_date <= test_end GROUP BY fold HAVING count(*) FILTER (business_date BETWEEN val_start AND val_end) > 0"


@query(_p(_BASE, doubles="base_wape base_mae base_bias", longs="fold"))
def fold_baseline(spark: SparkSession, d: str) -> DataFrame:
    return backtest.fold_baseline(*with_folds(spark, d))


@query(_p(_BASE, doubles="base_wape base_mae base_bias", longs="fold"))
def write_fold_results(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    io.write_fold_results(backtest.fold_baseline(*with_folds(spark, d)), path)
    return spark.read.schema("fold int, train_rows long, base_wape double, base_mae double, base_bias double").option("header", True).csv(path)


_SCORED = "SELECT fold, sum(abs(demand - naive)) / nullif(sum(abs(demand)), 0) AS base_wape, sum(abs(demand - mean28)) / nullif(sum(abs(demand)), 0) AS model_wape FROM pred JOIN folds ON business_date BETWEEN test_start AND test_end GROUP BY fold"


@query(_p(f"SELECT avg(base_wape) AS mean_base_wape, stddev_samp(base_wape) AS std_base_wape, avg(model_wape) AS mean_model_wape, stddev_samp(model_wape) AS std_model_wape, avg(i) AS mean_improvement_pct, stddev_samp(i) AS std_improvement_pct, count(*) FILTER (model_wape < base_wape) AS folds_won, count(*) AS folds FROM (SELECT *, 100 * (base_wape - model_wape) / base_wape AS i FROM ({_SCORED}) AS s) AS t", doubles="mean_base_wape std_base_wape mean_model_wape std_model_wape mean_improvement_pct std_improvement_pct"))
def backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(predicted(spark, d))
    test = backtest.assign_folds(rows, backtest.make_folds(rows)).where("block = 'test'")
    base = forecast.forecast_metrics(test, ["fold"], "naive").select("fold", F.col("wape").alias("base_wape"))
    both = base.join(forecast.forecast_metrics(test, ["fold"], "mean28").select("fold", F.col("wape").alias("model_wape")), "fold")
    return backtest.backtest_summary(both.withColumn("improvement_pct", 100 * (F.col("base_wape") - F.col("model_wape")) / F.col("base_wape")))


@query()
def rolling_origin_backtest(spark: SparkSession, d: str) -> DataFrame:
    return backtest.rolling_origin_backtest(*with_folds(spark, d))


@query()
def ablation(spark: SparkSession, d: str) -> DataFrame:
    return backtest.ablation(*with_folds(spark, d))


_VARIANTS = {"full": "mean28", "drop rolling": "naive", "calendar only": "mean7"}
_VARIED = " UNION ALL ".join(f"SELECT '{v}' AS variant, demand, naive AS base, {p} AS p FROM pred WHERE split = 'test'" for v, p in _VARIANTS.items())
_VARIED = f"SELECT variant, sum(abs(demand - p)) / nullif(sum(abs(demand)), 0) AS wape, sum(abs(demand - base)) / nullif(sum(abs(demand)), 0) AS base FROM ({_VARIED}) AS l GROUP BY variant"


@query(_p(f"SELECT variant, n_features, wape, delta, still_better_pct, CASE WHEN abs(delta) < 0.01 THEN 'negligibly' WHEN abs(delta) < 0.03 THEN 'modestly' ELSE 'substantially' END AS verdict FROM (SELECT variant, CAST(1 AS BIGINT) AS n_features, wape, wape - max(wape) FILTER (variant = 'full') OVER () AS delta, 100 * (base - wape) / base AS still_better_pct FROM ({_VARIED}) AS v) AS t", doubles="wape delta still_better_pct"))
def ablation_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Table and verdict of an ablation over stored predictions, for which three simple forecasts stand in."""
    rows = predicted(spark, d).where("split = 'test'").select("demand", F.col("naive").alias("base"), "mean28", "naive", "mean7")
    named = {p: v for v, p in _VARIANTS.items()}
    long = rows.unpivot(["demand", "base"], list(named), "p", "pred").replace(named, subset=["p"]).withColumnRenamed("p", "variant")
    return backtest.ablation_verdict(backtest.ablation_table(long.withColumn("n_features", F.lit(1))))


@query()
def backtest_summary_trained(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation and folds won over the retrained model's own folds, and its WAPE by category."""
    rows, folds = with_folds(spark, d)
    predictions = backtest.fold_predictions(rows, folds)
    summary = backtest.backtest_summary(backtest.backtest_table(rows, folds, predictions)).withColumn("category", F.lit("all"))
    return summary.unionByName(forecast.segment_wape(predictions).withColumnRenamed("wape", "mean_model_wape"), allowMissingColumns=True)


_KINDS = {c: backtest.feature_group(c) for c in _INPUTS}
_COUNTED = " UNION ALL ".join(f"SELECT '{g}' AS grp, count({c}) AS filled, count(*) AS n FROM feat" for c, g in _KINDS.items())


@query(_p(f"SELECT grp, CAST(count(*) AS BIGINT) AS n_columns, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(n - filled) AS BIGINT) AS nulls FROM ({_COUNTED}) AS c GROUP BY grp"))
def feature_groups(spark: SparkSession, d: str) -> DataFrame:
    return backtest.feature_group_profile(matrix(spark, d))
