"""Mixing sources to target weights by Pareto order sampling.

Every source first gets its whole copies. What its target has beyond them is a sample without replacement of a fixed number of words. A document's
inclusion probability is proportional to its size; documents whose probability would reach 1 are certain, and the others share what is left, until none
exceeds 1. Each document draws u, its random odds u / (1 - u) are divided by its inclusion odds p / (1 - p), and documents are taken in
that order, certain ones first, as long as they fit. The last place goes to the document that fits the remaining gap best. Draws are hashed from doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import released, small, stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: A source's cut is sought among so many rows by a window, among more by another digit of the order.
ROWS_PER_CUT = 1_000
RANK_BITS = 52
ORDER = ("rank", "h", "row")
#: The order's digits of eight bits, most significant first: (column, shift).
DIGITS = [(c, max(0, s)) for c, top in zip(ORDER, (RANK_BITS, 63, 63), strict=True) for s in range(top - 8, -8, -8)]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: one row for each source of sizes (source, size, n: rows of that size).

    Sources in code point order, null last, take the weights in turn. The words of all sources are shared by weight; a target
    stops at `most` times its source and the excess is reshared by weight until none is above. That fixed point is
    least(most * size, c * weight) with one level c: with sources in order of cap / weight, c is the greatest of
    (words not yet given to smaller caps) / (weights not yet served). The turn is a place among all sources, so its windows see all of them: one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((turn - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    unserved = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    per = per.withColumn("level", left.cast("double") / unserved)
    level = F.max("level").over(everything)
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def inclusion_slopes(sizes: DataFrame, rest: DataFrame) -> DataFrame:
    """of, slope: a document of size s is included with probability least(1, slope * s), so that the expected words of the source's sample are `rest` (of, rest).

    Documents longer than the whole rest can't be part of it and have no chance (but may be the last, best fitting one). With sizes in falling order, the slope at a size is (rest - words of larger documents) / (squares of this
    and smaller sizes), both from running sums in rising order; larger ones are certain. The first size that isn't certain by its own slope gives the source's slope; where all are certain, the last. One row a source and distinct size is seen, not one a document.
    """
    rows = sizes.where("size > 0").join(rest, F.col("source").eqNullSafe(F.col("of"))).where("size <= rest")
    whole, rising = Window.partitionBy("source"), Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words, squares = F.col("size") * F.col("n"), (F.col("size").cast("decimal(19,0)") * F.col("size") * F.col("n")).cast("decimal(38,0)")
    certain = F.sum(words).over(whole) - F.sum(words).over(rising)
    rows = rows.select("of", "size", ((F.col("rest") - certain) / F.sum(squares).over(rising).cast("double")).alias("slope"))
    open_ = F.max(F.when(F.col("slope") * F.col("size") < 1, F.struct("size", "slope")))["slope"]
    return rows.groupBy("of").agg(F.coalesce(open_, F.min_by("slope", "size")).alias("slope"))


def _rank(u: Column, chance: Column) -> Column:
    """Place in the Pareto order as a whole number of RANK_BITS bits; null where nothing is to be included, 0 where inclusion is certain."""
    odds = (u / (1 - u)) * ((1 - chance) / chance)
    return F.when(chance >= 1, 0).when(chance > 0, F.floor(odds / (1 + odds) * float(2**RANK_BITS))).cast("long")


def first_beyond(rows: DataFrame, limits: DataFrame, n_sources: int) -> DataFrame:
    """of, cut: the first row (rank, h, row) of each source whose words, added to those of all rows before it, exceed the source's limit (of, rest); no row where all fit.

    A source is never sorted: words are summed by the order's next eight bits (at most 256 cells a source, with map-side sums), the cell in which the
    limit lies is kept, and so on until it has ROWS_PER_CUT rows or the order has no more bits.
    """
    old: list[DataFrame] = []
    for column, shift in DIGITS:
        digit = F.shiftrightunsigned(column, shift).bitwiseAND(255)
        cells = rows.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("upto", upto).join(small(limits, n_sources), F.col("source").eqNullSafe(F.col("of"))).where("upto > rest")
        found = cells.groupBy("of").agg(F.min(F.struct("digit", "upto", "words", "rest")).alias("c"))
        found = stored(found.select("of", F.col("c.digit").alias("digit"), (F.col("c.rest") - (F.col("c.upto") - F.col("c.words"))).alias("rest")), "mix-cells")
        at = found.select(F.col("of").alias("at"), F.col("digit").alias("wanted"))
        rows = rows.join(small(at, n_sources), F.col("source").eqNullSafe(F.col("at")) & (digit == F.col("wanted"))).drop("at", "wanted")
        rows, limits = stored(rows.select("source", *ORDER, "size"), "mix-near"), found.select("of", "rest")
        old += [found, rows]
        most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= ROWS_PER_CUT:
            break
    upto = F.sum("size").over(Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).join(small(limits, n_sources), F.col("source").eqNullSafe(F.col("of")))
    cuts = stored(rows.where("upto > rest").groupBy("of").agg(F.min(F.struct(*ORDER)).alias("cut")), "mix-cuts")
    released(*old)
    return cuts


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and size, source_size, target, taken (words, repeats counted) for every row of docs (doc_id, text, source).

    A null or blank text has size 0 and taken 0; documents without source are a source of their own, last in order. Rows of equal doc_id draw alike and
    are told apart by their texts' hashes; rows that are equal in both are alike in the result, whichever of them is taken. A null doc_id draws like any other value. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    u = (F.conv(F.substring(F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.lit(seed))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)
    rows = docs.select(F.struct(*keep).alias("kept"), "source", size.alias("size"), u.alias("u"), h.alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "mix-rows", "zstd")
    sizes = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    target = source_targets(sizes, weights, most)
    target = target.withColumn("copies", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    target = target.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    target = stored(target.withColumnRenamed("source", "of"), "mix-targets")
    slopes = inclusion_slopes(sizes, target.select("of", "rest")).withColumnRenamed("of", "at")
    target = stored(target.join(slopes, F.col("of").eqNullSafe(F.col("at")), "left").drop("at"), "mix-slopes")
    n_sources = target.count()
    rows = rows.join(small(target, n_sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("rank", _rank(F.col("u"), F.when(F.col("size") <= F.col("rest"), F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("size")).otherwise(0.0))).drop("u", "slope")
    cuts = first_beyond(rows.where("rank is not null").select("source", *ORDER, "size"), target.select("of", "rest"), n_sources)
    rows = rows.join(small(cuts, n_sources), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    sampled = F.col("rank").isNotNull() & F.coalesce(F.struct(*ORDER) < F.col("cut"), F.col("cut").isNull())
    rows = rows.withColumn("sampled", sampled).drop("cut")
    given = rows.groupBy("source").agg(F.sum(F.when(F.col("sampled"), F.col("size")).otherwise(0)).alias("given"))
    given = stored(given.withColumnRenamed("source", "of"), "mix-given")
    rows = rows.join(small(given, n_sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    gap = F.col("rest") - F.col("given")
    fits = (F.col("size") > 0) & ~F.col("sampled") & (F.abs(F.col("size") - gap) < gap)
    place = F.coalesce("rank", F.lit(1 << RANK_BITS)).alias("rank")
    last = rows.where(fits).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("miss"), place, "h", "row")).alias("last"))
    last = stored(last.select(F.col("source").alias("of"), F.col("last.row").alias("last_row")), "mix-last")
    rows = rows.join(small(last, n_sources), F.col("source").eqNullSafe(F.col("of")), "left")
    more = F.when(F.col("sampled") | F.coalesce(F.col("row") == F.col("last_row"), F.lit(False)), 1).otherwise(0)
    return rows.select("kept.*", "size", "source_size", "target", (F.col("size") * (F.col("copies") + more)).cast("long").alias("taken"))


#: The same mix in one pass of plain windows, for comparison on small tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS DOUBLE)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level FROM s1
       WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM s2),
s4 AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS BIGINT) AS copies FROM s3),
s5 AS (SELECT *, target - copies * source_size AS rest FROM s4),
p0 AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
p1 AS (SELECT p0.source, size, (rest - coalesce(sum(size * n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / CAST(sum(size * size * n) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS slope
       FROM p0 JOIN s5 ON p0.source IS NOT DISTINCT FROM s5.source WHERE size <= rest WINDOW w AS (PARTITION BY p0.source ORDER BY size DESC)),
p2 AS (SELECT source, coalesce(arg_max(slope, size) FILTER (slope * size < 1), arg_min(slope, size)) AS slope FROM p1 GROUP BY source),
r0 AS (SELECT d.*, source_size, target, copies, rest, CASE WHEN size <= rest THEN coalesce(slope, 0) * size ELSE 0 END AS chance,
         (CAST(CAST('0x' || substr(md5(concat_ws('/', CAST(doc_id AS VARCHAR), 'mix')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
       FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN p2 ON d.source IS NOT DISTINCT FROM p2.source),
r1 AS (SELECT *, CASE WHEN chance >= 1 THEN 0 WHEN chance > 0 THEN (u / (1 - u)) * ((1 - chance) / chance) END AS odds FROM r0),
r2 AS (SELECT *, CAST(floor(odds / (1 + odds) * 4503599627370496.0::DOUBLE) AS BIGINT) AS rank FROM r1),
r3 AS (SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS sampled FROM r2),
r4 AS (SELECT *, rest - sum(CASE WHEN sampled THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM r3),
r5 AS (SELECT *, size > 0 AND NOT sampled AND abs(size - gap) < gap AS fits FROM r4),
r6 AS (SELECT *, fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - gap), rank, doc_id) = 1 AS last FROM r5)
SELECT doc_id, size, source_size, target, size * (copies + CASE WHEN sampled OR last THEN 1 ELSE 0 END) AS taken FROM r6
"""
