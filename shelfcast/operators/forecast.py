"""Splits, forecasters, blends and their scores."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfcast.functions.errors import clipped, error_metrics, wape
from shelfcast.functions.holidays import holiday_dates
from shelfcast.operators import trees
from shelfcast.operators.trees import CATEGORICALS, TreeRules

#: Ids, the target, and what is known only after the target day.
NOT_INPUTS = ("store_id", "product", "category", "business_date", "demand", "revenue", "txn_count", "refund_units", "outlier_txns", "ts_local")


def select_model_features(columns: list[str]) -> list[str]:
    """The three categoricals, then every column that is no id, target or same-day outcome."""
    return [*CATEGORICALS, *(c for c in columns if c not in NOT_INPUTS)]


def one_day(features: DataFrame, last_day: date | None = None) -> DataFrame:
    """last: one row, last_day or else the greatest business_date of features."""
    if last_day is None:
        return features.agg(F.max("business_date").alias("last"))
    return features.sparkSession.range(1).select(F.lit(last_day).cast("date").alias("last"))


def temporal_split(features: DataFrame, test_days: int = 45, val_days: int = 30, last_day: date | None = None) -> DataFrame:
    """features with `split`: the last test_days are test, the val_days before them val, all earlier days train. With last_day (see keep_matrix), features is read once."""
    d = F.col("business_date")
    last = F.lit(last_day).cast("date") if last_day else F.col("_last")
    rows = features if last_day else features.crossJoin(F.broadcast(one_day(features).withColumnRenamed("last", "_last")))
    test = F.date_sub(last, test_days - 1)
    split = F.when(d >= test, "test").when(d >= F.date_sub(test, val_days), "val").otherwise("train")
    return rows.withColumn("split", split).drop("_last")


def split_profile(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("business_date").alias("first_day"), F.max("business_date").alias("last_day"))


def training_rows(split: DataFrame) -> DataFrame:
    """Train and val rows: all history before the test block."""
    return split.where(F.col("split").isin("train", "val"))


def seasonal_naive(features: DataFrame, out: str = "pred") -> DataFrame:
    return features.withColumn(out, clipped(F.col("demand_lag_7").cast("double")))


#: Columns of the additive model: level, trend, weekdays after Monday, yearly waves, holiday.
WAVES = tuple((f, k) for k in (1, 2, 3) for f in ("sin", "cos"))
WIDTH = 2 + 6 + len(WAVES) + 1
#: Days are counted from here; years whose holidays are known to the model.
ORIGIN, YEARS = date(2000, 1, 1), (1970, 2070)


def design(d: Column) -> Column:
    """The row of the design matrix for a date, as an array of WIDTH doubles. The penalty leaves the level alone and takes both waves of a frequency alike, so the forecast doesn't depend on ORIGIN."""
    t = F.datediff(d, F.lit(ORIGIN).cast("date")).cast("double")
    week = [(F.weekday(d) == k).cast("double") for k in range(1, 7)]
    waves = [getattr(F, f)(2 * F.pi() * k * t / 365.25) for f, k in WAVES]
    holiday = d.isin([F.lit(h).cast("date") for h in holiday_dates(*YEARS)]).cast("double")
    return F.array(F.lit(1.0), t / 365.25, *week, *waves, holiday)


def decomposition_statistics(history: DataFrame) -> DataFrame:
    """store_id, product, n, xx, xy: for each series the rows with demand, the upper triangle of X'X (row by row) and X'y.

    Sums of products by series are all that a linear fit needs: they are made by one aggregation with partial sums, however many days a series has.
    """
    rows = history.where("demand is not null").select("store_id", "product", F.col("demand").cast("double").alias("y"), design(F.col("business_date")).alias("x"))
    x = F.col("x")
    pairs = [F.sum(x[i] * x[j]) for i in range(WIDTH) for j in range(i, WIDTH)]
    return rows.groupBy("store_id", "product").agg(F.count(F.lit(1)).alias("n"), F.array(*pairs).alias("xx"), F.array(*[F.sum(x[i] * F.col("y")) for i in range(WIDTH)]).alias("xy"))


def solve_ridge(xx: np.ndarray, xy: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients for each row of upper triangles xx and right sides xy; the level isn't penalised."""
    full = np.zeros((len(xx), WIDTH, WIDTH))
    i, j = np.triu_indices(WIDTH)
    full[:, i, j] = full[:, j, i] = xx
    full += np.diag([0.0, *[penalty] * (WIDTH - 1)]) + 1e-9 * np.eye(WIDTH)
    return np.linalg.solve(full, xy[:, :, None])[:, :, 0]


def decomposition_coefficients(statistics: DataFrame, least_points: int = 30, penalty: float = 1.0) -> DataFrame:
    """store_id, product, beta: the additive model of each series with least_points days or more."""

    @pandas_udf("array<double>")
    def solved(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series(list(solve_ridge(np.array(xx.tolist(), float).reshape(len(xx), -1), np.array(xy.tolist(), float).reshape(len(xy), -1), penalty)) if len(xx) else [], dtype=object)

    return statistics.where(F.col("n") >= least_points).select("store_id", "product", solved("xx", "xy").alias("beta"))


def seasonal_decomposition_forecast(history: DataFrame, ahead: DataFrame, least_points: int = 30, penalty: float = 1.0) -> DataFrame:
    """store_id, product, business_date, pred for the rows of `ahead`: one additive model a series, fitted by ridge on `history`.

    Only sums by series are shuffled and only the solution of WIDTH equations is numpy. Series with fewer than least_points days of demand, and such that history doesn't have, get null (use fall_back).
    """
    beta = decomposition_coefficients(decomposition_statistics(history), least_points, penalty)
    rows = ahead.select("store_id", "product", "business_date", design(F.col("business_date")).alias("_x")).join(beta, ["store_id", "product"], "left")
    fitted = F.aggregate(F.zip_with("_x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.select("store_id", "product", "business_date", clipped(fitted).alias("pred"))


def fall_back(primary: DataFrame, other: DataFrame, pred: str = "pred") -> DataFrame:
    """primary's predictions with nulls and missing rows taken from `other` (same keys)."""
    keys = ["store_id", "product", "business_date"]
    return other.join(primary.select(*keys, F.col(pred).alias("_p")), keys, "left").withColumn(pred, F.coalesce("_p", pred)).drop("_p")


def with_donors(rows: DataFrame, inputs: list[str], keys: tuple[str, ...] = ("store_id", "product", "business_date"), rows_per_task: int = 100_000, n_rows: int | None = None) -> DataFrame:
    """rows with `_donor`, a struct of another row's inputs: the one before it in the order of a hash of the keys, and for the first of a task the last.

    So every row gives its inputs to one other, which is a permutation that doesn't depend on how rows are stored. Hashes deal rows out over as many tasks as there are rows_per_task.
    """
    n_rows = rows.count() if n_rows is None else n_rows
    h = F.md5(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    part = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(max(1, -(-n_rows // rows_per_task)))).alias("_part")
    order = Window.partitionBy("_part").orderBy("_h")
    dealt = rows.select("*", h.alias("_h"), part)
    given = F.struct(*inputs)
    last = F.last(given).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return dealt.select("*", F.coalesce(F.lag(given).over(order), last).alias("_donor")).drop("_h", "_part")


def permutation_importance(rows: DataFrame, inputs: list[str], predict: Callable[[DataFrame], DataFrame], top: int | None = 12, keys: tuple[str, ...] = ("store_id", "product", "business_date")) -> DataFrame:
    """feature, wape, rise: how much the WAPE of predict(rows) (which adds `pred`) rises when one input is taken from other rows; the `top` inputs of the greatest rise, or all.

    All inputs are permuted in one pass: a row becomes one for each input, with that input from its donor (see with_donors), and one as it is, and predictions of all are scored by one aggregate.
    """
    donors = with_donors(rows, inputs, keys)
    keep = [c for c in donors.columns if c not in ("_donor", *inputs)]
    changed = donors.withColumn("_input", F.explode(F.array(F.lit("").alias("x"), *map(F.lit, inputs))))
    changed = changed.select(*keep, "_input", *[F.when(F.col("_input") == c, F.col("_donor")[c]).otherwise(F.col(c)).alias(c) for c in inputs])
    errors = predict(changed).groupBy("_input").agg(wape(F.col("demand"), F.col("pred")).alias("wape"))
    plain = errors.agg(F.max(F.when(F.col("_input") == "", F.col("wape"))).alias("_plain"))
    out = errors.where("_input <> ''").crossJoin(F.broadcast(plain)).select(F.col("_input").alias("feature"), "wape", (F.col("wape") - F.col("_plain")).alias("rise"))
    return out.orderBy(F.desc("rise"), "feature").limit(top) if top else out


#: The models that are compared, and the columns of their predictions.
MODELS = ("naive", "gbt", "decomposition")


def predict_all(split: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """Val and test rows of `split` with a prediction by each of MODELS.

    The trees are fitted on train and ended by val. A series' own model is fitted on train for val, and on train and val for test; where it can't be, the naive forecast stands in.
    """
    rows = seasonal_naive(split, "naive")
    known = training_rows(rows).withColumn("_val", F.col("split") == "val")
    model = trees.train_global_gbt(known, select_model_features([c for c in split.columns if c != "split"]), "_val", rules)
    ahead = trees.score(model, rows.where("split in ('val', 'test')"), "gbt")
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    own = seasonal_decomposition_forecast(train, val).union(seasonal_decomposition_forecast(train.union(val), test)).withColumnRenamed("pred", "_own")
    joined = ahead.join(own, ["store_id", "product", "business_date"], "left")
    return joined.withColumn("decomposition", F.coalesce("_own", "naive")).drop("_own")


def model_results(predicted: DataFrame) -> DataFrame:
    """model, wape, mae, rmse, bias, lift_pct, is_best, weight on the test rows of predict_all's table: each of MODELS and their ensemble, whose weights are those of least error on val."""
    best = tune_ensemble_weights(predicted.where("split = 'val'"), list(MODELS)).first()
    weights = {m: best[f"w_{m}"] for m in MODELS}
    test = blend_predictions(predicted.where("split = 'test'"), weights, "ensemble")
    metrics = compare_models(test, [*MODELS, "ensemble"])
    weight = F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("model"))
    return metrics.join(lift_over_baseline(metrics, "naive").drop("wape"), "model").withColumn("weight", weight)


def segment_results(predicted: DataFrame, segment: str = "category") -> DataFrame:
    """segment, model, wape: the test errors of each of MODELS for each segment, in one aggregate of predict_all's table."""
    long = predicted.where("split = 'test'").select(segment, "demand", *MODELS).unpivot([segment, "demand"], list(MODELS), "model", "pred")
    return long.groupBy(segment, "model").agg(wape(F.col("demand"), F.col("pred")).alias("wape"))


def blend_predictions(rows: DataFrame, weights: dict[str, float], out: str = "pred") -> DataFrame:
    return rows.withColumn(out, reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in weights.items()]))


def weight_grid(models: int) -> list[tuple[float, ...]]:
    """Steps of 0.1 over the first two models; the third takes the rest. With two models only pairs that sum to 1."""
    out = []
    for i in range(11):
        for j in range(11):
            a, b = i / 10, j / 10
            rest = round(1 - a - b, 10)
            if rest >= -1e-9 and (models > 2 or abs(rest) < 1e-9):
                out.append((a, b, max(rest, 0.0))[:models])
    return out


def tune_ensemble_weights(rows: DataFrame, models: list[str]) -> DataFrame:
    """One row: the weights of least validation error, first in grid order on a tie. All combinations are sums of one aggregate pass."""
    grid = weight_grid(len(models))
    sums = [F.sum(F.abs(F.col("demand") - reduce(lambda a, b: a + b, [F.lit(w) * F.col(m) for w, m in zip(ws, models, strict=True)]))).alias(f"e{i}") for i, ws in enumerate(grid)]
    total = rows.agg(*sums, F.sum(F.abs("demand")).alias("y"))
    scores = [F.struct(F.round(F.try_divide(F.col(f"e{i}"), F.col("y")), 9).alias("wape"), F.lit(i).alias("i"), *[F.lit(float(w)).alias(f"w_{m}") for w, m in zip(ws, models, strict=True)]) for i, ws in enumerate(grid)]
    best = F.array_min(F.array(*scores))
    return total.select(best.alias("b")).select(*[F.col(f"b.w_{m}") for m in models], F.col("b.wape").alias("wape"))


def forecast_metrics(rows: DataFrame, by: list[str] | None = None, pred: str = "pred") -> DataFrame:
    """WAPE, MAE, RMSE and bias; with `by` for each group."""
    m = error_metrics(F.col("demand"), F.col(pred))
    return rows.groupBy(*by).agg(*m) if by else rows.agg(*m)


def segment_wape(rows: DataFrame, segment: str = "category", pred: str = "pred") -> DataFrame:
    return rows.groupBy(segment).agg(wape(F.col("demand"), F.col(pred)).alias("wape"))


def compare_models(rows: DataFrame, models: list[str]) -> DataFrame:
    """A row of metrics for each prediction column."""
    long = rows.select("demand", *models).unpivot(["demand"], models, "model", "pred")
    return forecast_metrics(long, ["model"])


def lift_over_baseline(metrics: DataFrame, baseline: str) -> DataFrame:
    """Each model's improvement on the baseline in percent, and whether it is the best (least WAPE, then name)."""
    base = metrics.agg(F.max(F.when(F.col("model") == baseline, F.col("wape"))).alias("_base"), F.min_by("model", F.struct("wape", "model")).alias("_best"))
    lift = 100 * F.try_divide(F.col("_base") - F.col("wape"), F.col("_base"))
    return metrics.crossJoin(F.broadcast(base)).select("model", "wape", lift.alias("lift_pct"), (F.col("model") == F.col("_best")).alias("is_best"))
