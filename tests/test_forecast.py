import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast.functions.quantiles import exact_quantiles
from shelfcast.operators import backtest, forecast, monitor, trees
from shelfcast.operators.trees import TreeRules

START = date(2024, 1, 1)


def rows(spark, demand, **preds):
    out = [("S1", "diesel", "fuel", START + timedelta(days=i), float(y), *[float(p[i]) for p in preds.values()]) for i, y in enumerate(demand)]
    return spark.createDataFrame(out, "store_id string, product string, category string, business_date date, demand double" + "".join(f", {p} double" for p in preds))


def test_metrics(spark):
    got = forecast.forecast_metrics(rows(spark, [2, -2, 4], pred=[1, 0, 4])).first()
    assert got["wape"] == pytest.approx(3 / 8) and got["mae"] == 1 and got["bias"] == pytest.approx(1 / 3)
    assert forecast.forecast_metrics(rows(spark, [0, 0], pred=[1, 1])).first()["wape"] is None


def test_naive_clips_and_keeps_null(spark):
    data = spark.createDataFrame([(-3.0,), (None,), (2.0,)], "demand_lag_7 double")
    assert [r["pred"] for r in forecast.seasonal_naive(data).collect()] == [0.0, None, 2.0]


def test_split_blocks(spark):
    got = {r["split"]: (r["n_rows"], r["first_day"]) for r in forecast.split_profile(forecast.temporal_split(rows(spark, range(100)), 10, 20)).collect()}
    assert got == {"train": (70, START), "val": (20, START + timedelta(days=70)), "test": (10, START + timedelta(days=90))}


def test_first_weights_win_ties(spark):
    tied = forecast.tune_ensemble_weights(rows(spark, [1, 2], a=[1, 2], b=[1, 2], c=[1, 2]), ["a", "b", "c"]).first()
    assert (tied["a"] if "a" in tied else tied["w_a"], tied["w_b"], tied["w_c"]) == (0.0, 0.0, 1.0)
    assert len(forecast.weight_grid(3)) == 66 and len(forecast.weight_grid(2)) == 11
    best = forecast.tune_ensemble_weights(rows(spark, [10, 20], a=[0, 0], b=[20, 40]), ["a", "b"]).first()
    assert (best["w_a"], best["w_b"], best["wape"]) == (0.5, 0.5, 0.0)


def test_lift(spark):
    table = forecast.lift_over_baseline(forecast.compare_models(rows(spark, [10, 10], base=[5, 5], good=[10, 9]), ["base", "good"]), "base")
    got = {r["model"]: (round(r["lift_pct"], 6), r["is_best"]) for r in table.collect()}
    assert got == {"base": (0.0, False), "good": (90.0, True)}


def test_decomposition_beats_mean_and_falls_back(spark):
    y = [20 + 10 * ((START + timedelta(days=i)).weekday() == 5) + 0.05 * i for i in range(200)]
    data = rows(spark, y)
    cut = START + timedelta(days=170)
    fitted = forecast.seasonal_decomposition_forecast(data.where(F.col("business_date") < F.lit(cut)), data.where(F.col("business_date") >= F.lit(cut)))
    both = fitted.join(data, ["store_id", "product", "business_date"])
    assert fitted.count() == 30 and forecast.forecast_metrics(both).first()["wape"] < 0.1
    short = forecast.seasonal_decomposition_forecast(data.limit(5), data.where(F.col("business_date") >= F.lit(cut)))
    assert forecast.fall_back(short, data.where(F.col("business_date") >= F.lit(cut)).withColumn("pred", F.lit(7.0))).agg(F.min("pred")).first()[0] == 7.0


def test_decomposition_solves_the_normal_equations(spark):
    import numpy as np

    rng = random.Random(3)
    y = [20 + 6 * ((START + timedelta(days=i)).weekday() == 5) + 0.02 * i + rng.random() for i in range(400)]
    data = rows(spark, y).unionByName(rows(spark, range(10)).withColumn("store_id", F.lit("S2")))
    data = data.unionByName(data.limit(3).withColumn("demand", F.lit(None).cast("double")))
    table = forecast.decomposition_statistics(data)
    stats = {r["store_id"]: r for r in table.collect()}
    x = np.array([r[0] for r in data.where("store_id = 'S1' and demand is not null").orderBy("business_date").select(forecast.design(F.col("business_date"))).collect()])
    i, j = np.triu_indices(forecast.WIDTH)
    assert stats["S1"]["n"] == 400 and stats["S1"]["xx"] == pytest.approx((x.T @ x)[i, j].tolist()) and stats["S1"]["xy"] == pytest.approx((x.T @ np.array(y)).tolist())
    beta = {r["store_id"]: r["beta"] for r in forecast.decomposition_coefficients(table, penalty=2.0).collect()}
    assert set(beta) == {"S1"}  # ten days aren't enough
    b = np.array(beta["S1"])
    gradient = x.T @ (x @ b - np.array(y)) + 2.0 * np.concatenate([[0.0], b[1:]])
    assert np.abs(gradient).max() < 1e-4
    ahead = data.where("demand is null or business_date < '2024-01-05'")
    got = forecast.seasonal_decomposition_forecast(data, ahead, penalty=2.0).where("store_id = 'S1'").orderBy("business_date").collect()
    assert got[0]["pred"] == pytest.approx(float(x[0] @ b)) and forecast.seasonal_decomposition_forecast(data, ahead).where("store_id = 'S2' and pred is not null").count() == 0


def test_permutation_importance_ranks_what_the_model_uses(spark):
    rng = random.Random(6)
    data = [("S1", "p", START + timedelta(days=i), *(rng.random() for _ in range(3))) for i in range(500)]
    table = spark.createDataFrame(data, "store_id string, product string, business_date date, a double, b double, c double").withColumn("demand", 10 * F.col("a") + 2 * F.col("b") + 5)
    donors = forecast.with_donors(table, ["a", "b", "c"], rows_per_task=60).collect()
    assert sorted(r["_donor"]["a"] for r in donors) == sorted(r["a"] for r in donors) and sum(r["_donor"]["a"] != r["a"] for r in donors) == 500
    assert all([r["_donor"][k] for k in "abc"] in [[s[k] for k in "abc"] for s in donors] for r in donors[:40])
    again = {r["business_date"]: r["_donor"] for r in forecast.with_donors(table.repartition(7), ["a", "b", "c"], rows_per_task=60).collect()}
    assert all(again[r["business_date"]] == r["_donor"] for r in donors)
    found = forecast.permutation_importance(table, ["a", "b", "c"], lambda r: r.withColumn("pred", 10 * F.col("a") + 2 * F.col("b") + 5)).collect()
    assert [r["feature"] for r in found] == ["a", "b", "c"] and found[0]["rise"] > 3 * found[1]["rise"] > 0 and found[2]["rise"] == 0 and found[2]["wape"] == 0
    assert [r["feature"] for r in forecast.permutation_importance(table, ["a", "b", "c"], lambda r: r.withColumn("pred", 10 * F.col("a")), top=1).collect()] == ["a"]


def test_released_tables_are_gone(spark):
    import os

    from shelfcast.session import kept, release_all, released

    one, two = kept(spark.range(3), "one"), kept(spark.range(4), "two")
    path = lambda t: t.inputFiles()[0].removeprefix("file://")
    paths = [path(one), path(two)]
    released(one)
    assert [os.path.exists(p) for p in paths] == [False, True] and two.count() == 4
    release_all(spark)
    assert not any(map(os.path.exists, paths))


def odd_days(spark, n, val_from):
    data = rows(spark, [5.0 if i % 2 else 25.0 for i in range(n)]).withColumn("odd", (F.datediff("business_date", F.lit(START)) % 2).cast("double"))
    return data.withColumn("_val", F.col("business_date") > F.lit(START + timedelta(days=val_from)))


def test_gbt_learns_a_step(spark):
    data = odd_days(spark, 400, 300)
    model = trees.train_global_gbt(data, ["store_id", "product", "category", "odd"], "_val", TreeRules(rounds=15, depth=2))
    assert forecast.forecast_metrics(trees.score(model, data)).first()["wape"] < 0.3
    assert trees.feature_importance(model).first()["feature"] == "odd"


def noisy(spark, n=900):
    rng = random.Random(4)
    data = [(f"S{i % 5}", "p", "c", START + timedelta(days=i // 5), rng.random(), float(rng.randrange(9))) for i in range(n)]
    table = spark.createDataFrame(data, "store_id string, product string, category string, business_date date, a double, b double")
    demand = 3 * F.col("b") + 9 * F.sin(7 * F.col("a")) + F.ascii(F.substring("store_id", 2, 1)) + F.round(F.rand(5) * 2, 1)
    return table.withColumn("demand", demand).withColumn("_val", F.col("business_date") > F.lit(START + timedelta(days=n // 7)))


def test_blocks_are_one_long_fit_and_no_tree_is_fitted_twice(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    data = noisy(spark).cache()
    grown = []
    for kind, name in ((GBTRegressor, "maxIter"), (RandomForestRegressor, "numTrees")):
        monkeypatch.setattr(kind, "fit", lambda self, table, f=kind.fit, name=name: grown.append(self.getOrDefault(name)) or f(self, table))
    rules = TreeRules(rounds=11, depth=3, patience=99, row_share=1.0, column_share=1.0, first_block=4, block=3, least_rows=5)
    encoder = trees.fit_encoder(data.where("not _val"), ["store_id", "a", "b"])
    table = trees.encoded(encoder, data, "demand", "_val")
    model = trees.boost(table, "_val", rules)
    assert grown == [4] + [1] * 7
    long = GBTRegressor(featuresCol="_features", labelCol="demand", maxIter=11, maxDepth=3, maxBins=64, stepSize=0.3, minInstancesPerNode=5, seed=1).fit(table.where("not _val"))
    errors = long.evaluateEachIteration(table.where("_val"), "absolute")
    best = trees.best_round(errors, 99)
    assert len(model.trees) == best and best > 4 and list(model.treeWeights) == list(long.treeWeights)[:best]
    kept_rounds = trees.of_trees(long, list(long._java_obj.trees())[:best], list(long.treeWeights)[:best])
    got, want = ([r["_raw_pred"] for r in m.transform(table).orderBy("demand", "_features").collect()] for m in (model, kept_rounds.setPredictionCol("_raw_pred")))
    assert got == pytest.approx(want, abs=1e-6)


def test_boosting_ends_behind_the_best_round(spark, monkeypatch):
    assert trees.best_round([3.0, 3.1, 2.0, 2.5, 2.5], 40) == 3 and trees.best_round([3.0, 3.1, 3.1, 2.0], 1) == 1
    rules = TreeRules(rounds=50, patience=3)
    assert trees.ended([3.0, 2.0, 2.5, 2.5, 2.5], rules) and not trees.ended([3.0, 2.0, 2.5, 2.5], rules) and trees.ended([1.0 / (i + 1) for i in range(50)], rules)
    data = noisy(spark).withColumn("demand", F.when(F.col("_val"), F.col("demand") + 500).otherwise(F.col("demand")))
    asked = []
    monkeypatch.setattr(trees, "ended", lambda errors, rules, f=trees.ended: asked.append(len(errors)) or f(errors, rules))
    model = trees.train_global_gbt(data, ["a", "b"], "_val", TreeRules(rounds=600, patience=3, first_block=2, block=2, depth=2))
    best = len(model.stages[-1].trees)
    assert asked == list(range(2, asked[-1] + 1, 2)) and best + 3 <= asked[-1] <= best + 5


def test_registered_queries_do_the_whole_job(spark, monkeypatch):
    import shelfcast.plans.registry
    from shelfcast.plans import forecast_queries as q

    asked = []
    start = rows(spark, range(10))
    monkeypatch.setattr(q, "with_folds", lambda spark, d: (start, start))
    monkeypatch.setattr(q, "predicted", lambda spark, d: start.withColumn("split", F.lit("val")))
    monkeypatch.setattr(trees, "train_global_gbt", lambda *a, **k: asked.append((a, k)))
    monkeypatch.setattr(trees, "feature_importance", lambda model: start)
    monkeypatch.setattr(backtest, "rolling_origin_backtest", lambda features, folds, **k: asked.append(((), k)) or start)
    q.feature_importance(spark, "")
    q.rolling_origin_backtest(spark, "")
    assert asked[0][0][2] == "_val" and len(asked[0][0]) == 3 and not any(k for _, k in asked)


def many_stores(spark, stores, days=60):
    data = [(f"S{s:03d}", p, "fuel", START + timedelta(days=i), float(10 + s % 7 + 5 * (i % 7 == 5)), None if i < 20 else float(i % 5)) for s in range(stores) for p in ("diesel",) for i in range(days)]
    return spark.createDataFrame(data, "store_id string, product string, category string, business_date date, demand double, price double")


@pytest.mark.parametrize("stores", [100, 3000])
def test_trees_take_any_number_of_stores_and_nulls(spark, stores):
    data = many_stores(spark, stores, 6 if stores > 100 else 60)
    columns = ["store_id", "product", "category", "price"]
    model = trees.train_global_gbt(data, columns, rules=TreeRules(rounds=6, bins=32, least_rows=1, column_share=1.0))
    out = trees.score(model, data.unionByName(data.limit(1).withColumn("store_id", F.lit("new"))).unionByName(data.limit(1).withColumn("store_id", F.lit(None).cast("string"))))
    assert out.where("pred is null").count() == 0 and out.count() == data.count() + 2 and model.stages[-1].getMaxBins() == 32
    # demand depends on the store's number alone but for Saturdays: the order of mean demand finds it at either width
    assert trees.score(model, data).agg(F.avg(F.abs(F.col("pred") - F.col("demand")))).first()[0] < 2.2


def test_all_models_end_to_end(spark):
    data = many_stores(spark, 8, 130).withColumn("demand_lag_7", F.lag("demand", 7).over(Window.partitionBy("store_id").orderBy("business_date"))).where("demand_lag_7 is not null")
    split = forecast.temporal_split(data, 20, 15)
    predicted = forecast.predict_all(split, TreeRules(rounds=3)).persist()
    assert predicted.count() == 8 * 35 and predicted.where("naive is null or gbt is null or decomposition is null").count() == 0
    table = {r["model"]: r for r in forecast.model_results(predicted).collect()}
    assert set(table) == {*forecast.MODELS, "ensemble"} and sum(table[m]["weight"] for m in forecast.MODELS) == pytest.approx(1)
    test = predicted.where("split = 'test'").collect()
    for m in forecast.MODELS:
        assert table[m]["wape"] == pytest.approx(sum(abs(r["demand"] - r[m]) for r in test) / sum(r["demand"] for r in test))
    for r in forecast.segment_results(predicted).collect():
        assert r["wape"] == pytest.approx(table[r["model"]]["wape"])  # all of one category
    blend = [sum(table[m]["weight"] * r[m] for m in forecast.MODELS) for r in test]
    assert table["ensemble"]["wape"] == pytest.approx(sum(abs(r["demand"] - p) for r, p in zip(test, blend)) / sum(r["demand"] for r in test))


def test_monitor_of_a_trained_model(spark):
    stores = spark.createDataFrame([(f"S{i:03d}", "highway" if i % 2 else "urban") for i in range(8)], "store_id string, store_type string")
    data = monitor.attach_store_type(many_stores(spark, 8, 150), stores)
    cut = [str(START + timedelta(days=n)) for n in (60, 80)]
    scored = monitor.score_periods(monitor.split_reference_production(data, *cut), TreeRules(rounds=3)).persist()
    assert scored.count() == 8 * 150 and scored.where("period <> 'train' and pred is null").count() == 0
    changed = monitor.inject_regime_change(scored, str(START + timedelta(days=110)), factor=0.3)
    healthy = monitor.operating_wape(monitor.weekly_wape(scored.where("period = 'production'")))
    assert monitor.monitor(changed.withColumns({c: F.lit(1.0) for c in monitor.INPUTS}), healthy)["decision"].first()["retrain"] is True


def with_lag(data):
    return data.withColumn("demand_lag_7", F.lag("demand", 7).over(Window.partitionBy("store_id").orderBy("business_date"))).where("demand_lag_7 is not null")


def test_backtest_over_folds(spark, monkeypatch):
    data = with_lag(many_stores(spark, 4, 150)).cache()
    folds = backtest.make_folds(data, 4, 20, 15)
    encoders, tables = [], []
    monkeypatch.setattr(trees, "fit_encoder", lambda rows, *a, f=trees.fit_encoder: encoders.append(rows.agg(F.max("business_date")).first()[0]) or f(rows, *a))
    monkeypatch.setattr(trees, "encoded", lambda *a, f=trees.encoded, **k: tables.append(f(*a, **k)) or tables[-1])
    predictions = backtest.fold_predictions(data, folds, TreeRules(rounds=3, depth=2))
    of = {f["fold"]: f for f in folds.collect()}
    assert encoders == [of[1]["train_end"]] and len(tables) == 1  # inputs are encoded once, by what the oldest fold knows
    assert predictions.count() == 4 * 20 * 4 and all(of[r["fold"]]["test_start"] <= r["business_date"] <= of[r["fold"]]["test_end"] for r in predictions.collect())
    table = {r["fold"]: r for r in backtest.backtest_table(data, folds, predictions).collect()}
    for k, rows_of in ((k, [r for r in predictions.collect() if r["fold"] == k]) for k in table):
        assert table[k]["model_wape"] == pytest.approx(sum(abs(r["demand"] - r["pred"]) for r in rows_of) / sum(r["demand"] for r in rows_of))
        assert table[k]["base_wape"] == pytest.approx(sum(abs(r["demand"] - r["base"]) for r in rows_of) / sum(r["demand"] for r in rows_of))
    assert set(table) == {1, 2, 3, 4} and backtest.rolling_origin_backtest(data, backtest.make_folds(data, 2, 200, 200)).count() == 0


def test_one_at_a_time_or_side_by_side(spark):
    order = trees.side_by_side(spark, range(7), lambda i: spark.range(i).count(), 3)
    assert order == list(range(7))
    with pytest.raises(ZeroDivisionError):
        trees.side_by_side(spark, [1, 0], lambda i: 1 // i)


def test_ablation_keeps_the_baseline_beside_it(spark):
    data = many_stores(spark, 4, 150).withColumn("demand_lag_7", F.lit(12.0))
    got = {r["variant"]: r for r in backtest.ablation(data, rules=TreeRules(rounds=1, depth=1)).collect()}
    assert {"full", "drop lags", "calendar only"} <= set(got) and got["full"]["delta"] == 0 and got["full"]["verdict"] == "negligibly"
    assert got["drop lags"]["n_features"] == got["full"]["n_features"] - 1
    last = data.where(F.col("business_date") > F.lit(START + timedelta(days=119)))
    base = forecast.forecast_metrics(forecast.seasonal_naive(last)).first()["wape"]
    assert got["full"]["still_better_pct"] == pytest.approx(100 * (base - got["full"]["wape"]) / base)


@pytest.mark.parametrize("most", [10, 10**6])
def test_exact_quantiles(spark, most):
    import numpy as np

    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=5000), "b": rng.integers(0, 7, 3000).astype(float), "c": np.array([1.0]), None: rng.exponential(size=4001)}
    data = spark.createDataFrame([(g, float(x)) for g, of in groups.items() for x in of] + [("a", None)], "g string, x double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    limit = most if most > 10 else 2999
    got = {r["g"]: r["q"] for r in exact_quantiles(data, "g", "x", probs, limit).collect()}
    assert set(got) == set(groups)
    for g, of in groups.items():
        assert got[g] == pytest.approx(np.quantile(of, probs).tolist())


def test_folds(spark):
    data = rows(spark, range(400))
    folds = backtest.make_folds(data).orderBy("fold").collect()
    assert all(a["test_end"] < b["test_start"] for a, b in zip(folds, folds[1:])) and folds[-1]["test_end"] == START + timedelta(days=399)
    assert all(f["train_end"] + timedelta(days=1) == f["val_start"] and (f["test_end"] - f["test_start"]).days == 29 for f in folds)
    short = rows(spark, range(70)).withColumn("demand_lag_7", F.col("demand"))
    assert [r["fold"] for r in backtest.fold_baseline(short, backtest.make_folds(short)).collect()] == [5, 4] or backtest.fold_baseline(short, backtest.make_folds(short)).count() in (1, 2)
    wins = backtest.backtest_summary(spark.createDataFrame([(0.5, 0.4, 20.0), (0.5, 0.6, -20.0)], "base_wape double, model_wape double, improvement_pct double")).first()
    assert wins["folds_won"] == 1 and wins["mean_improvement_pct"] == 0


def test_groups_and_verdicts(spark):
    from shelfcast.operators.features import CALENDAR, DAILY, HISTORY

    groups = backtest.feature_groups(forecast.select_model_features([*DAILY, *CALENDAR, *HISTORY]))
    assert {g: len(c) for g, c in groups.items()} == {"categorical": 3, "price_current": 2, "calendar": 13, "lags": 4, "rolling": 12, "price_past": 2}
    table = backtest.ablation_verdict(spark.createDataFrame([(0.005,), (-0.02,), (0.03,)], "delta double"))
    assert [r["verdict"] for r in table.collect()] == ["negligibly", "modestly", "substantially"]


def psi(spark, reference, current):
    data = spark.createDataFrame([("x", float(v) if v is not None else None, s) for s, of in (("r", reference), ("c", current)) for v in of], "feature string, value double, side string")
    return monitor.population_stability_index(data, F.col("side") == "r", F.col("side") == "c").first()["psi"]


def test_psi(spark):
    assert psi(spark, range(100), range(100)) == pytest.approx(0, abs=1e-9)
    assert psi(spark, range(100), [200] * 50) > 2
    assert psi(spark, range(9), range(100)) is None and psi(spark, [*range(9), None], range(100)) is None
    weekdays = [i % 7 for i in range(700)]
    assert psi(spark, weekdays, weekdays) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize(("pattern", "want"), [("TFTTTF", 3), ("FFF", 0), ("TTTT", 4)])
def test_longest_run(spark, pattern, want):
    weekly = spark.createDataFrame([(START + timedelta(weeks=i), 1.0 if p == "T" else 0.1) for i, p in enumerate(pattern)], "week date, wape double")
    assert monitor.max_consecutive_degraded(weekly, 0.5).first()["max_run"] == want


@pytest.mark.parametrize(("weeks", "inputs", "target", "want"), [([1, 1, 0], 0.0, 0.0, True), ([1, 0, 1], 0.0, 0.0, False), ([0, 0, 0], 0.3, 0.0, True), ([0, 0, 0], 0.0, 0.3, True), ([0, 0, 0], None, None, False)])
def test_decision(spark, weeks, inputs, target, want):
    weekly = spark.createDataFrame([(START + timedelta(weeks=i), 0.9 if w else 0.1) for i, w in enumerate(weeks)], "week date, wape double")
    table = lambda name, v: spark.createDataFrame([(name, v)], "feature string, psi double")
    got = monitor.retrain_decision(weekly, spark.createDataFrame([(0.5,)], "operating_wape double"), table("dow", inputs), table("demand", target)).first()
    assert got["retrain"] is want and bool(got["reasons"]) is want


def test_regime_change_makes_highway_worst(spark):
    data = rows(spark, [10] * 60, pred=[10] * 60).withColumn("store_type", F.when(F.dayofmonth("business_date") % 2 == 0, "highway").otherwise("urban"))
    changed = monitor.inject_regime_change(data, "2024-02-01")
    assert monitor.segment_health(monitor.weekly_wape(changed, "store_type")).first()["store_type"] == "highway"
    assert monitor.segment_health(monitor.weekly_wape(data, "store_type")).agg(F.max("mean_wape")).first()[0] == 0
