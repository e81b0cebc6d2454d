"""Boosted trees over all series: inputs are encoded and cut into bins once, and boosting goes on from the trees that are there."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import Bucketizer, SQLTransformer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import kept, released

CATEGORICALS = ("store_id", "product", "category")
#: What nulls count as, below every other value.
MISSING = -1e9
#: Categories are hashed into so many classes, whatever their number; classes of one hash share their place in the order.
CLASSES = 1 << 16

T, S = TypeVar("T"), TypeVar("S")


@dataclass(frozen=True)
class TreeRules:
    """How trees are grown and when boosting ends: the model keeps the rounds up to the one of least absolute validation error, found by looking `patience` rounds beyond each new best,
    and never grows more than `rounds`. TreeRules(step=0.05, patience=40) goes the same way in steps a sixth as large, with six times the trees.

    loss: "squared" fits residuals; "absolute" fits their signs, so a round moves a prediction by `step` units of demand at most.
    """

    rounds: int = 600
    step: float = 0.3
    patience: int = 7
    depth: int = 5
    bins: int = 64
    least_rows: int = 40
    row_share: float = 0.8
    column_share: float = 0.8
    loss: str = "squared"
    seed: int = 42
    #: Rounds before the first look at the validation rows, and between later ones.
    first_block: int = 28
    block: int = 8


def side_by_side(spark: SparkSession, of: Iterable[S], work: Callable[[S], T], at_once: int = 4) -> list[T]:
    """work(x) for each x, up to at_once at a time, each in a scheduler pool of its own (pools share the cores where spark.scheduler.mode is FAIR). The first failure is raised."""

    def one(job: tuple[int, S]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{job[0] % at_once}")
        try:
            return work(job[1])
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_once) as threads:
        return list(threads.map(inheritable_thread_target(spark)(one), enumerate(of)))


def _class(c: str) -> str:
    return f"CAST(pmod(xxhash64(`{c}`), {CLASSES}) AS STRING)"


def fit_encoder(rows: DataFrame, columns: list[str], bins: int = TreeRules.bins) -> PipelineModel:
    """Stages that turn `columns` into `_features`, learned from rows (with `demand`) that a model may know.

    A categorical becomes its place in the order of mean demand, by hashed class; a class that wasn't seen comes last. Every input is then cut into at most `bins` bins at quantiles (each value has a
    bin of its own where there are few), and nulls have the lowest bin to themselves. Bins are plain numbers to the trees. The driver sees CLASSES means a categorical, and `bins` edges an input.
    """
    cats = [c for c in CATEGORICALS if c in columns]
    filled = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), CAST({MISSING} AS DOUBLE)) AS `_{c}`" for c in columns if c not in cats)
    stages: list[Transformer] = [SQLTransformer(statement=f"SELECT *, {', '.join([*([filled] if filled else []), *[f'{_class(c)} AS `_class_{c}`' for c in cats]])} FROM __THIS__")]
    for c in cats:
        order = rows.groupBy(F.expr(_class(c)).alias("k")).agg(F.avg("demand").alias("m")).orderBy("m", "k").collect()
        stages.append(StringIndexerModel.from_labels([r["k"] for r in order], inputCol=f"_class_{c}", outputCol=f"_{c}", handleInvalid="keep"))
    known = PipelineModel(stages).transform(rows)
    share = F.array(*[F.lit(k / (bins - 1)) for k in range(1, bins - 1)])
    edges = known.agg(*[F.percentile_approx(F.when(F.col(f"_{c}") > MISSING / 2, F.col(f"_{c}")), share, 1_000).alias(c) for c in columns]).first()
    splits = [[float("-inf"), MISSING / 2, *sorted(set(edges[c] or [])), float("inf")] for c in columns]
    stages.append(Bucketizer(inputCols=[f"_{c}" for c in columns], outputCols=[f"_bin_{c}" for c in columns], splitsArray=splits, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[f"_bin_{c}" for c in columns], outputCol="_features", handleInvalid="error"))
    return PipelineModel(stages)


def inputs_of(encoder: PipelineModel) -> list[str]:
    """The encoder's inputs, in the order of `_features`."""
    assembler = next(s for s in encoder.stages if isinstance(s, VectorAssembler))
    return [c.removeprefix("_bin_") for c in assembler.getInputCols()]


def encoded(encoder: PipelineModel, rows: DataFrame, *keep: str | Column, at_once: int = 1) -> DataFrame:
    """The columns `keep` and `_features` of rows, stored. All fits over these rows read this table.

    There are files enough for every core if at_once fits read them at a time (a small table in more pieces costs more than it gains); a reader splits large files by their size.
    """
    plain = F.col("_features").alias("_features", metadata={})  # else the trees would take bins for unordered categories
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return kept(encoder.transform(rows).select(*keep, plain).repartition(-(-cores // at_once)), "vectors")


def best_round(errors: list[float], patience: int) -> int:
    """The number of rounds with the least error, as found by stopping `patience` rounds after the last new best."""
    best = 0
    for i, e in enumerate(errors):
        if i - best > patience:
            break
        if e < errors[best]:
            best = i
    return best + 1


def ended(errors: list[float], rules: TreeRules) -> bool:
    return len(errors) >= rules.rounds or best_round(errors, rules.patience) + rules.patience <= len(errors)


def of_trees(like: GBTRegressionModel, trees: list, weights: list[float]) -> GBTRegressionModel:
    """A boosted model of the given trees (of the JVM) with the parameters of `like`."""
    gateway, java = SparkContext._active_spark_context._gateway, like._java_obj
    tree_array = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weight_array = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        tree_array[i], weight_array[i] = tree, weight
    model = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), tree_array, weight_array, java.numFeatures())
    return GBTRegressionModel(java.copyValues(model, java.extractParamMap()))


def boost(table: DataFrame, validation: str | None = None, rules: TreeRules = TreeRules(), features: str = "_features") -> GBTRegressionModel:
    """A model of `demand` over `features`. `validation` names a boolean column whose true rows aren't fitted but end the boosting; without it all `rounds` are grown.

    The first block is one fit of Spark's boosting. It can't go on from a fitted model, so later rounds grow a tree each on what the model leaves (its gradient, as in the first block), and a
    block's predictions are added to a kept column before the next block. No tree is fitted twice, and blocks don't change the model where rows and columns aren't sampled.
    """
    common = {"featuresCol": features, "maxDepth": rules.depth, "minInstancesPerNode": rules.least_rows, "maxBins": rules.bins, "subsamplingRate": rules.row_share, "featureSubsetStrategy": str(rules.column_share)}
    first = GBTRegressor(labelCol="demand", predictionCol="_raw_pred", lossType=rules.loss, maxIter=min(rules.first_block, rules.rounds) if validation else rules.rounds, stepSize=rules.step, seed=rules.seed, **common)
    if not validation:
        return first.fit(table)
    fitted, held = table.where(~F.col(validation)), table.where(validation)
    model = first.fit(fitted)
    trees, weights, errors = list(model._java_obj.trees()), list(model.treeWeights), model.evaluateEachIteration(held, "absolute")
    rest = table.select("demand", validation, features).repartition(table.sparkSession.sparkContext.defaultParallelism)
    block: GBTRegressionModel = model
    while not ended(errors, rules):
        old, rest = rest, block.transform(rest).withColumn("demand", F.col("demand") - F.col("_raw_pred")).drop("_raw_pred").persist()
        block_trees: list = []
        for _ in range(min(rules.block, rules.rounds - len(trees))):
            so_far = of_trees(model, block_trees, [rules.step] * len(block_trees)).transform(rest) if block_trees else rest.withColumn("_raw_pred", F.lit(0.0))
            left = F.col("demand") - F.col("_raw_pred")
            gradient = 2 * left if rules.loss == "squared" else F.when(left < 0, -1.0).otherwise(1.0)
            tree = RandomForestRegressor(labelCol="_gradient", numTrees=1, bootstrap=False, seed=rules.seed + len(trees) + len(block_trees), **common)
            block_trees.append(tree.fit(so_far.where(~F.col(validation)).select(features, gradient.alias("_gradient")))._java_obj.trees()[0])
        block = of_trees(model, block_trees, [rules.step] * len(block_trees))
        errors += block.evaluateEachIteration(rest.where(validation), "absolute")
        trees, weights = trees + block_trees, weights + [rules.step] * len(block_trees)
        old.unpersist()
    rest.unpersist()
    best = best_round(errors, rules.patience)
    return of_trees(model, trees[:best], weights[:best])


def train_global_gbt(rows: DataFrame, columns: list[str], validation: str | None = None, rules: TreeRules = TreeRules()) -> PipelineModel:
    """One boosted-tree model for all series: encoder and trees. `validation` names a boolean column whose true rows aren't known to either but end the boosting (see TreeRules).

    Every row is fitted and scored: nulls have a bin of their own, categories that weren't seen a place of their own.
    """
    known = rows.where(~F.col(validation)) if validation else rows
    encoder = fit_encoder(known, columns, rules.bins)
    table = encoded(encoder, rows, "demand", *([validation] if validation else []))
    model = PipelineModel([*encoder.stages, boost(table, validation, rules)])
    released(table)
    return model


def score(model: PipelineModel, rows: DataFrame, out: str = "pred") -> DataFrame:
    kept_columns = rows.columns
    return model.transform(rows).withColumn(out, F.greatest(F.col("_raw_pred"), F.lit(0.0))).select(*kept_columns, out)


def sliced(table: DataFrame, encoder: PipelineModel, inputs: list[str], out: str = "_slice") -> DataFrame:
    """table with only `inputs` in the vector `out`."""
    at = {c: i for i, c in enumerate(inputs_of(encoder))}
    return VectorSlicer(inputCol="_features", outputCol=out, indices=[at[c] for c in inputs]).transform(table)


def feature_importance(model: PipelineModel, top: int = 12) -> DataFrame:
    """feature, importance: the inputs that the trees gain most by."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(inputs_of(model), values, strict=True))
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


