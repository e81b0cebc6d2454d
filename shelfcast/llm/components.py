"""Connected components by alternating large and small stars; no neighbourhood is ever collected, and the rows of a hub are cut into parts.

Each star and its least neighbours are stored: a plan that holds a whole round grows to hundreds of nodes, and the driver keeps every version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import any_hot, hot_join, released, stored


def _star(rows: DataFrame, kept: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """kept (u, v) with m, the least of u and all its neighbours in rows (u, v); and the stored u, m, n of every u in rows."""
    least = stored(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    return hot_join(kept, least.select("u", "m"), ["u"], any_hot(least, ["u"], n_rows), F.col("v")), least


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met, least = _star(both, both.where("v > u"), 2 * n)
    out = stored(met.select(F.col("v").alias("u"), F.col("m").alias("v")), "star")
    released(least)
    return out


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met, least = _star(down, down, n)
    out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = stored(out.where("u <> v").distinct(), "edges")
    released(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of edges (u, v); self-edges and repeats are harmless."""
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    n, state = edges.count(), None
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        large = _large_star(edges, n)
        new = _small_star(large, n)
        released(edges, large)
        edges, now = new, new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
        n, state = now[0], now
