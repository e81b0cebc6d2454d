"""Near duplicates by SimHash fingerprints that differ in two bits at most, found by multi-index hashing.

A fingerprint is cut into an upper and a lower segment of 32 bits. Of two that differ in at most two bits, either the upper segments differ in at most one, or the lower ones
in none. So one table holds fingerprints by upper and one by lower segment; each fingerprint looks up the ball of radius one around its upper segment and its own
lower segment, and every match is verified by its complete distance. Of a pair whose upper segments differ in one bit, only the side with a 0 there asks.

A bucket of many fingerprints (HOT) is never expanded into pairs. Two fingerprints differ in at most two bits just when some value differs from each in at most one, their
midpoint. Members of a hot bucket, and those that look it up, are met by midpoints inside the bucket: any two that share one are linked, and at most 65 can.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from shelfcast.llm.common import LOWER, bounded_batches, hot, hot_join, released, small, stored
from shelfcast.llm.components import components

WORDS, SEED, DISTANCE = 3, 42, 2
#: Fingerprints of one segment value from which a bucket is met by midpoints instead of pairs.
HOT = 64
#: Shingles whose bits are counted at a time.
AT_ONCE = 1 << 16
_LOW = LOWER.tobytes()
_UPPER, _LOWER = ([1 << i if i < 63 else -(1 << 63) for i in range(a, a + 32)] for a in (32, 0))


def fingerprint_of(text: bytes | None) -> int:
    """64 bits, signed: each is 1 if it is set in over half of the text's shingle hashes, repeats included. Fewer than three words are one shingle; no words give 0."""
    words = text.translate(_LOW).split() if text else []
    if not words:
        return 0
    joined, k = b" ".join(words), min(WORDS, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends, starts = ends[k - 1 :].tolist(), starts[: len(words) - k + 1].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(ends), AT_ONCE):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(ends), bitorder="little")
    return int(bits.view("<i8")[0])


@arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t.as_py()) for t in texts], pa.int64())


def _with_bits(c: Column, masks: list[int], clear_only: bool = False) -> Column:
    """c with each of the masks' bits turned; with clear_only just those that are 0 in c."""
    each = F.array(*map(F.lit, masks))
    chosen = F.filter(each, lambda m: c.bitwiseAND(m) == 0) if clear_only else each
    return F.transform(chosen, lambda m: c.bitwiseXOR(m))


def _bucket(c: Column, segment: int) -> Column:
    """The segment's bits of c with those of the other segment 0. A bucket is a segment (0: upper, 1: lower) and this key."""
    return c.bitwiseAND(F.lit(~0xFFFFFFFF if segment == 0 else 0xFFFFFFFF))


def _in_table(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _bucket(F.col("fp"), s).alias("key")) for s in (0, 1)])).alias("b")).select("fp", "b.*")


def _probes(fps: DataFrame) -> DataFrame:
    """fp, segment, key: the buckets one bit away from the upper segment, from the side with a 0 there."""
    near = F.explode(_with_bits(F.col("fp"), _UPPER, clear_only=True))
    return fps.select("fp", near.alias("near")).select("fp", F.lit(0).alias("segment"), _bucket(F.col("near"), 0).alias("key"))


def _by_midpoints(members: DataFrame, visitors: DataFrame) -> DataFrame:
    """u, v: links among the members (fp, segment, key) of hot buckets, and between them and visitors, whose upper segment is one bit away from the bucket's key."""
    other = F.when(F.col("segment") == 0, F.concat(F.array("fp"), _with_bits(F.col("fp"), _LOWER))).otherwise(F.concat(F.array("fp"), _with_bits(F.col("fp"), _UPPER)))
    rows = members.select("fp", F.explode(other).alias("midpoint"))
    rows = rows.union(visitors.select("fp", F.col("key").bitwiseOR(_bucket(F.col("fp"), 1)).alias("midpoint")))
    met = rows.groupBy("midpoint").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")


def links(fps: DataFrame, hot_from: int = HOT) -> DataFrame:
    """u, v: pairs of different fingerprints of fps (fp, distinct) at DISTANCE or less, enough of them that their components are those of all such pairs.

    Outside hot buckets every pair is there; inside, members of one midpoint are linked with the least of them.
    """
    table = _in_table(fps)
    crowded = stored(table.groupBy("segment", "key").count().where(F.col("count") >= hot_from).select("segment", "key", F.lit(True).alias("hot")), "hot-buckets")
    n = crowded.count()
    mark = lambda rows: rows.join(small(crowded, n), ["segment", "key"], "left")
    table, probes = mark(table), mark(_probes(fps))
    # a hot bucket's midpoints need the visitors from both sides of the bit, not only those that ask
    around = fps.select("fp", F.explode(_with_bits(F.col("fp"), _UPPER)).alias("near")).select("fp", F.lit(0).alias("segment"), _bucket(F.col("near"), 0).alias("key"))
    visitors = around.join(small(crowded, n), ["segment", "key"]).select("fp", "key")
    midpoints = _by_midpoints(table.where("hot"), visitors)
    cool = table.where("hot is null").select("segment", "key", F.col("fp").alias("v"))
    asked = probes.where("hot is null").select("segment", "key", F.col("fp").alias("u"), F.lit(True).alias("near"))
    asked = asked.union(table.where("hot is null").select("segment", "key", F.col("fp").alias("u"), F.lit(False)))
    met = asked.join(cool, ["segment", "key"]).where(F.col("near") | (F.col("u") < F.col("v")))
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE).select("u", "v").union(midpoints)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long), component_id for every row of docs (doc_id, text); other columns are ignored.

    Null, empty and blank texts have fingerprint 0 and link like others. Rows link by their own texts, whether their doc_id is null or repeats; component_id is
    the least doc_id of the component, null if no row in it has one. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = stored(docs.select("doc_id", fingerprints(F.col("text").cast("binary")).alias("fp")), "fingerprints")
    per = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    label = stored(components(links(per.select("fp"))), "labels")
    of = per.join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("root"))
    of = stored(of, "roots")
    released(label, per)
    roots = stored(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    n_fps, n_rows = of.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = hot_join(of.select("fp", "root", "n"), roots.select("root", "component_id"), ["root"], hot(roots, ["root"], n_fps), F.col("fp"))
    named = stored(named.select("fp", "n", "component_id"), "named")
    released(of, roots)
    found = hot_join(rows, named.select("fp", "component_id"), ["fp"], hot(named, ["fp"], n_rows), F.coalesce("doc_id", F.lit(0)))
    return found.select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
