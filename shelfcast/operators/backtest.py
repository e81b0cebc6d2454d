"""Rolling-origin backtest and feature ablation."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from shelfcast.functions.errors import wape
from shelfcast.operators import forecast, trees
from shelfcast.operators.features import CALENDAR
from shelfcast.operators.forecast import one_day
from shelfcast.operators.trees import TreeRules
from shelfcast.session import kept, released


def make_folds(features: DataFrame, n_folds: int = 5, test_days: int = 30, val_days: int = 30, last_day: date | None = None) -> DataFrame:
    """Fold dates stepping back from the last day: test blocks don't overlap, val stands before test, train is all earlier; the oldest fold is 1.

    With last_day (see keep_matrix) the folds are made from that date and features isn't read; else it is aggregated for it.
    """
    last = one_day(features, last_day).where("last is not null")
    rows = last.select("last", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
    end = F.date_sub("last", (n_folds - F.col("fold")) * test_days)
    rows = rows.select("fold", end.alias("test_end")).withColumn("test_start", F.date_sub("test_end", test_days - 1))
    rows = rows.withColumn("val_end", F.date_sub("test_start", 1)).withColumn("val_start", F.date_sub("val_end", val_days - 1))
    return rows.withColumn("train_end", F.date_sub("val_start", 1)).select("fold", "train_end", "val_start", "val_end", "test_start", "test_end")


def assign_folds(features: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once for each fold that it belongs to, with its block. Folds are a handful of rows and broadcast."""
    d = F.col("business_date")
    block = F.when(d <= F.col("train_end"), "train").when(d.between(F.col("val_start"), F.col("val_end")), "val").when(d.between(F.col("test_start"), F.col("test_end")), "test")
    return features.join(F.broadcast(folds), d <= F.col("test_end")).withColumn("block", block).where("block is not null")


def fold_baseline(features: DataFrame, folds: DataFrame) -> DataFrame:
    """For each fold with val and test rows: training rows and the seasonal naive's WAPE, MAE and bias on its test block."""
    rows = assign_folds(forecast.seasonal_naive(features), folds)
    test = F.col("block") == "test"
    y, p = F.when(test, F.col("demand")), F.when(test, F.col("pred"))
    out = rows.groupBy("fold").agg(
        F.count_if(F.col("block") == "train").alias("train_rows"), F.count_if(F.col("block") == "val").alias("_val"), F.count_if(test).alias("_test"),
        wape(y, p).alias("base_wape"), F.avg(F.abs(p - y)).alias("base_mae"), F.avg(p - y).alias("base_bias"),
    )
    return out.where("_val > 0 and _test > 0").drop("_val", "_test")


#: Columns of a table of predictions beside what names the fit.
PREDICTED = ("store_id", "product", "business_date", "category", "demand", "base", "pred")


def _prepared(features: DataFrame, before: date, at_once: int) -> tuple[PipelineModel, DataFrame]:
    """An encoder that knows the rows up to `before`, and all rows encoded by it and stored, with the naive forecast as `base`: one table that every fit reads."""
    rows = forecast.seasonal_naive(features, "base")
    encoder = trees.fit_encoder(rows.where(F.col("business_date") <= before), forecast.select_model_features(features.columns))
    return encoder, trees.encoded(encoder, rows, *[c for c in PREDICTED if c != "pred"], at_once=at_once)


def _fold(table: DataFrame, fold: Row) -> tuple[DataFrame, DataFrame]:
    """The rows that a fold's model may use, with `_val` for those that end its boosting, and the rows that it has to predict."""
    d = F.col("business_date")
    return table.where(d <= fold["val_end"]).withColumn("_val", d >= fold["val_start"]), table.where(d.between(fold["test_start"], fold["test_end"]))


def _predictions(model: GBTRegressionModel, test: DataFrame, **named: str | int) -> DataFrame:
    rows = model.transform(test).withColumn("pred", F.greatest("_raw_pred", F.lit(0.0)))
    return rows.select(*[F.lit(v).alias(k) for k, v in named.items()], *PREDICTED)


def usable(features: DataFrame, folds: DataFrame) -> list[Row]:
    """The folds that have training, val and test rows, oldest first: a row each."""
    counts = assign_folds(features.select("business_date"), folds).groupBy("fold").agg(*[F.count_if(F.col("block") == b).alias(b) for b in ("train", "val", "test")])
    return folds.join(F.broadcast(counts), "fold").where("train > 0 and val > 0 and test > 0").orderBy("fold").collect()


def fold_predictions(features: DataFrame, folds: DataFrame, rules: TreeRules = TreeRules(), at_once: int = 5) -> DataFrame | None:
    """fold and PREDICTED for the test rows of each usable fold, by a model retrained for the fold; None without such a fold. features should be stored.

    Inputs are encoded once, by what the oldest fold's training rows tell, so no fold knows anything of its val or test rows. Folds are date filters of that table and are fitted at_once at a time.
    The predictions are stored: all tables of a backtest are aggregates of them.
    """
    of = usable(features, folds)
    if not of:
        return None
    _, table = _prepared(features, min(f["train_end"] for f in of), at_once)

    def fit(fold: Row) -> DataFrame:
        known, test = _fold(table, fold)
        return _predictions(trees.boost(known, "_val", rules), test, fold=fold["fold"])

    out = kept(reduce(DataFrame.unionByName, trees.side_by_side(features.sparkSession, of, fit, at_once)), "fold-predictions")
    released(table)
    return out


def fold_scores(predictions: DataFrame) -> DataFrame:
    """fold, model_wape, model_mae, model_bias of a table of fold predictions."""
    return forecast.forecast_metrics(predictions, ["fold"]).select("fold", F.col("wape").alias("model_wape"), F.col("mae").alias("model_mae"), F.col("bias").alias("model_bias"))


def backtest_table(features: DataFrame, folds: DataFrame, predictions: DataFrame) -> DataFrame:
    """fold, train_rows, errors of the seasonal naive and of the predictions, the fold's dates, improvement_pct: a row for each fold with predictions."""
    both = fold_baseline(features, folds).join(F.broadcast(fold_scores(predictions)), "fold").join(F.broadcast(folds), "fold")
    return both.withColumn("improvement_pct", 100 * F.try_divide(F.col("base_wape") - F.col("model_wape"), F.col("base_wape")))


def rolling_origin_backtest(features: DataFrame, folds: DataFrame | None = None, rules: TreeRules = TreeRules(), at_once: int = 5) -> DataFrame:
    """Baseline and a retrained global model for each fold (see make_folds); empty if no fold has training, val and test rows."""
    folds = make_folds(features) if folds is None else folds
    predictions = fold_predictions(features, folds, rules, at_once)
    if predictions is None:
        nothing = features.sparkSession.createDataFrame([], "fold int, store_id string, product string, business_date date, category string, demand double, base double, pred double")
        return backtest_table(features, folds, nothing)
    return backtest_table(features, folds, predictions)


def backtest_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation of errors and improvement over folds, and folds won."""
    spread = [f(c).alias(f"{n}_{c}") for c in ("base_wape", "model_wape", "improvement_pct") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return folds.agg(*spread, F.count_if(F.col("model_wape") < F.col("base_wape")).alias("folds_won"), F.count(F.lit(1)).alias("folds"))


def feature_group(name: str) -> str:
    if name in forecast.CATEGORICALS:
        return "categorical"
    if name in CALENDAR:
        return "calendar"
    if name.startswith("demand_lag_"):
        return "lags"
    if name.startswith("demand_"):
        return "rolling"
    return {"avg_unit_price": "price_current", "price_change_1": "price_current", "price_lag_1": "price_past", "txn_count_lag_1": "price_past"}.get(name, "other")


def feature_groups(columns: list[str]) -> dict[str, list[str]]:
    """Model inputs by kind; kinds without columns are left out."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(feature_group(c), []).append(c)
    return out


def feature_group_profile(features: DataFrame) -> DataFrame:
    """grp, n_columns, filled, nulls: values present and missing in the model inputs of each kind, in one pass over the matrix."""
    columns = forecast.select_model_features(features.columns)
    counts = features.agg(*[F.count(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_rows"))
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, feature_group(c))])
    long = counts.unpivot(["_rows"], columns, "input", "filled").withColumn("grp", kinds[F.col("input")])
    return long.groupBy("grp").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("filled").alias("filled"), F.sum(F.col("_rows") - F.col("filled")).alias("nulls"))


def variants_of(columns: list[str]) -> dict[str, list[str]]:
    """The inputs of each variant: all, each kind left out, calendar and categoricals alone."""
    groups = feature_groups(columns)
    out = {"full": columns} | {f"drop {g}": [c for c in columns if c not in of] for g, of in groups.items()} | {"calendar only": [*groups.get("categorical", []), *groups.get("calendar", [])]}
    return {name: inputs for name, inputs in out.items() if inputs}


def ablation_predictions(features: DataFrame, folds: DataFrame, rules: TreeRules = TreeRules(), at_once: int = 8) -> DataFrame | None:
    """variant, n_features and PREDICTED for the test rows of the latest usable fold, stored; None without such a fold. Variants are slices of one encoded table and are fitted at_once at a time."""
    of = usable(features, folds)
    if not of:
        return None
    encoder, table = _prepared(features, of[-1]["train_end"], at_once)
    known, test = _fold(table, of[-1])

    def fit(variant: tuple[str, list[str]]) -> DataFrame:
        name, inputs = variant
        model = trees.boost(trees.sliced(known, encoder, inputs), "_val", rules, "_slice")
        return _predictions(model, trees.sliced(test, encoder, inputs), variant=name, n_features=len(inputs))

    variants = variants_of(forecast.select_model_features(features.columns))
    out = kept(reduce(DataFrame.unionByName, trees.side_by_side(features.sparkSession, variants.items(), fit, at_once)), "ablation-predictions")
    released(table)
    return out


def ablation_table(predictions: DataFrame, full: str = "full") -> DataFrame:
    """variant, n_features, wape, delta, still_better_pct from a table of predictions by variant, in one aggregate.

    delta is the variant's WAPE above that of `full`; still_better_pct is the improvement on the naive forecast (`base`) that the variant keeps.
    """
    y = F.col("demand")
    out = predictions.groupBy("variant", "n_features").agg(wape(y, F.col("pred")).alias("wape"), wape(y, F.col("base")).alias("_base"))
    whole = out.agg(F.max(F.when(F.col("variant") == full, F.col("wape"))).alias("_full"))
    out = out.crossJoin(F.broadcast(whole))
    still = 100 * F.try_divide(F.col("_base") - F.col("wape"), F.col("_base"))
    return out.select("variant", "n_features", "wape", (F.col("wape") - F.col("_full")).alias("delta"), still.alias("still_better_pct"))


def ablation(features: DataFrame, folds: DataFrame | None = None, rules: TreeRules = TreeRules(), at_once: int = 8) -> DataFrame:
    """ablation_table with its verdict, of variants fitted on the latest usable fold; empty if there is none. A null verdict says that there is no delta."""
    predictions = ablation_predictions(features, make_folds(features) if folds is None else folds, rules, at_once)
    if predictions is None:
        predictions = features.sparkSession.createDataFrame([], "variant string, n_features int, demand double, base double, pred double")
    return ablation_verdict(ablation_table(predictions))


def ablation_verdict(table: DataFrame) -> DataFrame:
    """table with a word for how much each variant costs."""
    size = F.abs("delta")
    return table.withColumn("verdict", F.when(size < 0.01, "negligibly").when(size < 0.03, "modestly").when(size.isNotNull(), "substantially"))
