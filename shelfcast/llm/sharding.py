"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child of the node reached draws
-ln(u) / weight with u hashed from (doc_id, child), and the least draw wins, so a child gets keys in proportion
to its weight. A draw depends on its own child alone: when one child's weight rises, keys move only into that
child's subtree, and when it falls, only out of it. A tree grows by whole new regions, each of which starts with
one shard, so one more shard takes rows only into itself, whatever the number of shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACKS_PER_REGION = 2
SHARDS_PER_RACK = 4
ROWS_PER_BUCKET = 10_000
#: Equal rows are spread over tasks in blocks of so many.
COPIES_PER_BLOCK = 10_000


@dataclass(frozen=True)
class Node:
    """A subtree: children for a region or rack, a shard number for a leaf."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def balanced_tree(n_shards: int, weights: dict[int, float] | None = None, base: int | None = None) -> Node:
    """A tree of n_shards shards, in shard order. A node weighs what its shards weigh.

    The first `base` shards (a whole number of regions; by default as many as there are) fill regions of RACKS_PER_REGION racks of SHARDS_PER_RACK shards; every
    later shard opens a region of its own. With the same base, the tree of one more shard differs by its new region alone.
    """
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    base = n_shards - n_shards % per_region if base is None else base
    if base % per_region or base > n_shards:
        raise ValueError(f"base must be a multiple of {per_region} and at most {n_shards}")
    weights = weights or {}

    def inner(name: str, children: list[Node]) -> Node:
        return Node(name, sum(c.weight for c in children), tuple(children))

    def rack(region: int, number: int, shards: range) -> Node:
        return inner(f"{region}/{number}", [Node(f"{region}/{number}/{s}", weights.get(s, 1.0), (), s) for s in shards])

    regions = []
    for region in range(base // per_region):
        first = region * per_region
        racks = [rack(region, i, range(first + i * SHARDS_PER_RACK, first + (i + 1) * SHARDS_PER_RACK)) for i in range(RACKS_PER_REGION)]
        regions.append(inner(str(region), racks))
    for shard in range(base, n_shards):
        region = base // per_region + shard - base
        regions.append(inner(str(region), [rack(region, 0, range(shard, shard + 1))]))
    return inner("", regions)


def _inner_nodes(node: Node) -> list[Node]:
    return [node, *(x for c in node.children for x in _inner_nodes(c))] if node.children else []


def _children_of(tree: Node) -> Column:
    """A constant map from a node's name to its children of positive weight (name, weight, shard)."""
    pairs = []
    for node in _inner_nodes(tree):
        children = [F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(c.shard).cast("int").alias("shard")) for c in node.children if c.weight > 0]
        pairs += [F.lit(node.name), F.array(*children)]
    return F.create_map(*pairs)


def _winner(key: Column, children: Column) -> Column:
    """The child with the least draw; a tie goes to the lesser name."""

    def draw(child: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat_ws("/", key.cast("string"), child["name"])), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["name"].alias("name"), child["shard"].alias("shard"))

    return F.array_min(F.transform(children, draw))


def assign_shard(df: DataFrame, tree: Node, out: str, key: str = "doc_id") -> DataFrame:
    """df with the shard of `key` in column `out`. Only the draws on the row's own path are made. A null key draws by the children's names alone."""
    depth, node = 0, tree
    while node.children:
        depth, node = depth + 1, node.children[0]
    children, at = _children_of(tree), f"__{out}"
    df = df.withColumn(at, F.struct(F.lit(0.0).alias("draw"), F.lit(tree.name).alias("name"), F.lit(None).cast("int").alias("shard")))
    for _ in range(depth):
        df = df.withColumn(at, _winner(F.col(key), F.element_at(children, F.col(at)["name"])))
    return df.withColumn(out, F.col(at)["shard"]).drop(at)


def shard_documents(docs: DataFrame, n_shards: int = 40, base: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text; other columns are ignored).

    Size is the text's UTF-8 bytes (null: none) plus 16. grown_shard is the shard with one more, on the same `base` (see balanced_tree). Slots count 0, 1, ... in
    each shard. Equal rows are counted before the shuffle and get neighbouring slots; a row that repeats without bound is one record until its copies are
    made in blocks, which are spread over tasks first. Slots are dealt by (shard, bucket of about ROWS_PER_BUCKET rows), so no shard is ever sorted in one task. A null text has the checksum
    of the empty text; an empty table gives an empty result.
    """
    n_buckets = max(1, -(-docs.count() // (n_shards * ROWS_PER_BUCKET)))
    tree = balanced_tree(n_shards, base=base)
    grown = balanced_tree(n_shards + 1, base=n_shards - n_shards % (RACKS_PER_REGION * SHARDS_PER_RACK) if base is None else base)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    rows = assign_shard(assign_shard(rows, tree, "shard"), grown, "grown_shard")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("size", "text_crc32", "doc_id"), F.lit(n_buckets)))
    totals = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(totals, ["shard", "bucket"])
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_PER_BLOCK).cast("long")))).hint("rebalance")
    copy = F.explode(F.sequence(F.col("block"), F.least("copies", F.col("block") + COPIES_PER_BLOCK) - 1))
    rows = rows.withColumn("copy", copy)
    slot = (F.col("offset") + F.col("first") + F.col("copy")).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def _tree_rows(tree: Node) -> str:
    return ", ".join(f"('{n.name}', '{c.name}', {c.weight}, {'NULL' if c.shard is None else c.shard})" for n in _inner_nodes(tree) for c in n.children)


def _descent(name: str) -> str:
    """Three levels of draws through the table `name`, in SQL."""
    out, at = [], "SELECT r, doc_id, '' AS node, CAST(NULL AS INT) AS shard FROM d"
    for level in range(3):
        draw = "-ln((CAST(CAST('0x' || substr(md5(concat_ws('/', CAST(doc_id AS VARCHAR), child)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE) / weight"
        out.append(f"{name}{level} AS (SELECT r, doc_id, arg_min(child, {draw}) AS node, arg_min(t.shard, {draw}) AS shard FROM ({at}) AS a JOIN {name} AS t ON t.parent = a.node GROUP BY r, doc_id)")
        at = f"SELECT r, doc_id, node, shard FROM {name}{level}"
    return ",\n".join(out)


#: The same shards by a table of tree nodes, and the checksum from its definition; for comparison on tables of one bucket (40 * ROWS_PER_BUCKET rows).
ORACLE = f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT r, CAST(len(h) // 2 + 16 AS BIGINT) AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM d, crc),
now(parent, child, weight, shard) AS (VALUES {_tree_rows(balanced_tree(40))}),
grown(parent, child, weight, shard) AS (VALUES {_tree_rows(balanced_tree(41, base=40))}),
{_descent("now")},
{_descent("grown")}
SELECT d.doc_id, size, text_crc32, 'key' AS law, now2.shard AS shard, row_number() OVER (PARTITION BY now2.shard ORDER BY d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown2.shard AS grown_shard
FROM d JOIN sums USING (r) JOIN now2 USING (r) JOIN grown2 USING (r)
"""
