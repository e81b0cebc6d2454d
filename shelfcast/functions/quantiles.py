"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.joins import small
from shelfcast.session import kept

#: Groups of more values are cut down to brackets first.
MOST_IN_ONE_TASK, ACCURACY = 200_000, 1_000


def exact_quantiles(rows: DataFrame, by: str, value: str, probs: tuple[float, ...], most: int = MOST_IN_ONE_TASK) -> DataFrame:
    """by, q (an array, one for each of probs, interpolated between neighbours) of the values that aren't null. A null `by` is a group.

    rows should be stored: sizes of groups, and brackets of large ones, are looked at first. A group of up to `most` values has them counted in one task. In a larger one approximate quantiles with a proven error bracket each rank; values below a bracket are
    counted, and only distinct values inside a bracket (a few thousandths of the group) are sorted.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_x"))
    sizes = kept(rows.groupBy("_by").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    exact = lambda r: r.groupBy("_by").agg(F.percentile("_x", F.array(*map(F.lit, probs))).alias("q"))
    large = small(sizes.where(F.col("_n") > most).select(F.col("_by").alias("_g"), F.lit(True).alias("_large")))
    if large.isEmpty():
        return exact(rows).select(F.col("_by").alias(by), "q")
    dealt = rows.join(large, F.col("_by").eqNullSafe(F.col("_g")), "left").drop("_g")
    exact, rows = exact(dealt.where("_large is null")), dealt.where("_large").drop("_large")
    ends = [x for p in probs for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]
    brackets = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", ends, ACCURACY).alias("_e")).withColumnRenamed("_by", "_g")
    met = rows.join(small(kept(brackets, "brackets")), F.col("_by").eqNullSafe(F.col("_g")))
    per = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi"), F.lit(p).alias("p")) for i, p in enumerate(probs)]))
    inside = met.select("_by", "_n", "_x", per.alias("b")).where("_x <= b.hi")
    cell = F.when(F.col("_x") >= F.col("b.lo"), F.col("_x"))  # null: all values below the bracket are one cell
    cells = inside.groupBy("_by", "_n", F.col("b.i").alias("i"), F.col("b.p").alias("p"), cell.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_by", "i").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("p") * (F.col("_n") - 1)
    first = lambda r: F.min(F.when(F.col("upto") > r, F.col("x")))
    found = cells.withColumn("upto", upto).groupBy("_by", "i").agg(first(F.floor(rank)).alias("a"), first(F.ceil(rank)).alias("b"), F.first(rank - F.floor(rank)).alias("w"))
    at = F.struct("i", ((1 - F.col("w")) * F.col("a") + F.col("w") * F.col("b")).alias("v"))
    found = found.groupBy("_by").agg(F.transform(F.sort_array(F.collect_list(at)), lambda s: s["v"]).alias("q"))
    return exact.union(found).select(F.col("_by").alias(by), "q")
