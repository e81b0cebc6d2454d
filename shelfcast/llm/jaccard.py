"""N-gram Jaccard self-join by partitioning the universe, and near-duplicate classes from its links.

A document is its set of distinct five-word shingles. Two sets link when 9 |A & B| >= 4 (|A| + |B|), that is Jaccard 0.8 or more, so they
differ in H = (|A| + |B|) // 9 shingles at most.

Signatures. Sets are dealt by size into bands. In a band the hash space of shingles is cut into segments, and each non-empty segment
of a set, as a whole, is one signature. Of n signatures at most H change between linked sets, so whatever the common order of
signatures, the first H + 1 of either set share one (pigeonhole). Sets of up to 7 shingles are a single segment with its
one-deletion neighbourhood, since H <= 1 there; up to 127 shingles every shingle is a segment. A set near the lower border of its band also signs in the band below.

Allocation by cost. The order is by measured frequency, rarest first: a set with H + 1 signatures of its own costs nothing
further, and common passages are picked only by sets that hardly have anything else.

Verification. Each set is compared with the most typical set among its buckets (its pivot), which settles most links; sets without a link are compared
with a second pivot among themselves. Sets of one pivot that are not yet in one component are then joined on their differences from the pivot, again as
a prefix join with positions, and pairs across pivots that share a picked signature are compared directly. In a bucket only sets outside its most common component meet the others, so
a large family is never expanded into all pairs. 64-bit shingle hashes nominate links and reject pairs; every accepted link is counted on the words themselves.
Texts of equal words are one class by SHA-256 of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shelfcast.llm.common import IS_SPACE, LOWER, any_hot, bounded_batches, hot, hot_join, mixed, released, run_hashes, slices, small, spans, stored
from shelfcast.llm.components import components

WORDS = 5
TINY, SMALL = 7, 127
#: Shingles a segment at the upper end of a band, and the ratio of a band's ends.
PER_SEGMENT, BAND = 2.6, 2
#: One document in so many is looked at to find signatures that would fill a task; at most HEAVY_MOST of them can pass.
HEAVY_SAMPLE, HEAVY_LEAST, HEAVY_MOST, HEAVY_SALTS = 64, 48, 20_000, 512
#: Owners of one signature that vote in one task.
OWNERS_PER_TASK = 500
_LOW = LOWER.tobytes()
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than five words are one shingle, no words none."""
    none = np.zeros(0, np.uint64)
    for start, end, data, off in slices(texts):
        data = LOWER[data]
        first, after, row = spans(data, off, IS_SPACE)
        word = run_hashes(data, first, after)
        bounds = np.searchsorted(row, np.arange(end - start + 1))
        runs = np.full(max(0, len(word) - WORDS + 1), WORDS, np.uint64)
        for i in range(WORDS):
            runs += word[i : len(word) - WORDS + 1 + i] * _ODD[i]
        runs = mixed(runs)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                h = np.sort(runs[a : b - WORDS + 1])
                yield h[np.concatenate([[True], h[1:] != h[:-1]])]
            elif b > a:
                short = np.array([b - a], np.uint64)
                for i in range(b - a):
                    short += word[a + i : a + i + 1] * _ODD[i]
                yield mixed(short)
            else:
                yield none


def band(size: int) -> tuple[int, int]:
    """Number of the band of a set of this size, and the least size in it."""
    if size <= TINY:
        return 0, 1
    k, low = 1, TINY + 1
    while size > (SMALL if k == 1 else low * BAND - 1):
        k, low = k + 1, (SMALL + 1 if k == 1 else low * BAND)
    return k, low


def signatures(h: np.ndarray, k: int, low: int, every: bool = False) -> np.ndarray:
    """Signatures of a sorted set in band k; the lowest bit is the band's parity. With `every`, each shingle of a larger set is a segment."""
    tag = np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    v = mixed(h ^ tag)
    if k == 0:
        total = v.sum(dtype=np.uint64)
        s = np.concatenate([[total], total - v]) if len(v) > 1 else np.array([total], np.uint64)
    elif k == 1 or every:
        s = v
    else:
        segments = int(np.ceil(low * BAND * 1.25 / PER_SEGMENT))
        at = (h.astype(np.float64) * (segments / 2.0**64)).astype(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        s = np.add.reduceat(v, cut) + at[cut] * _ODD[1]
    return (mixed(s + tag) & ~np.uint64(1)) | np.uint64(k & 1)


def picks(size: int) -> tuple[int, int]:
    """How many signatures a set needs in its own band, and in the one below as the larger set of a pair."""
    return (size + size * 5 // 4) // 9 + 1, (2 * size - 1) // 9 + 1


def sketch(h: np.ndarray, fine: frozenset[int] = frozenset()) -> tuple[int, np.ndarray, np.ndarray, list[int]]:
    """Parity of the own band, its signatures, those in the band below, and the bands in which either set is too small for the pigeonhole.

    In the bands of `fine` every shingle is a segment of its own, which always meets the pigeonhole; sets of other bands keep theirs.
    """
    k, low = band(len(h))
    own = signatures(h, k, low, k in fine)
    below = np.zeros(0, np.uint64)
    if k and -(-4 * len(h) // 5) < low:
        below = signatures(h, k - 1, low // BAND if k > 2 else TINY + 1 if k == 2 else 1, k - 1 in fine)
    need, need_below = picks(len(h))
    poor = [k] * (k > 0 and len(own) < need) + [k - 1] * (k > 1 and 0 < len(below) < need_below)
    return k & 1, own, below, poor


def _words(text: bytes) -> list[bytes]:
    return text.translate(_LOW).split()


def _digest(text: bytes | None) -> bytes:
    return hashlib.sha256(b" ".join(_words(text or b""))).digest()


def _class_column(text: Column, fine: frozenset[int]) -> Column:
    def described(texts: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for h, t in zip(shingle_sets(texts), texts, strict=True):
            if len(h):
                parity, own, below, poor = sketch(h, fine)
                out.append((len(h), _digest(t.as_py()), parity, len(own), len(below), poor))
            else:
                out.append((0, None, 0, 0, 0, []))
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        names = ["n_shingles", "digest", "parity", "n_own", "n_below", "poor"]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return arrow_udf(described, "struct<n_shingles: long, digest: binary, parity: int, n_own: int, n_below: int, poor: array<int>>")(text)


def _signature_column(text: Column, fine: frozenset[int]) -> Column:
    def signed(texts: pa.Array) -> pa.Array:
        parts = []
        for h in shingle_sets(texts):
            _, own, below, _ = sketch(h, fine) if len(h) else (0, h, h, [])
            parts.append(np.concatenate([own, below]))
        return _long_lists(parts)

    return arrow_udf(signed, "array<long>")(text)


def _long_lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64)))


def word_shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text, as words."""
    words = _words(text)
    return set(zip(*[words[i:] for i in range(WORDS)], strict=False)) if len(words) >= WORDS else {tuple(words)} if words else set()


def _comparison(x: Column, y: Column) -> Column:
    """linked, by the words of both texts, and `difference`, the hashes of shingles that only one of them has. A y that repeats from row to row is taken apart once."""

    def compared(xs: pa.Array, ys: pa.Array) -> pa.Array:
        linked, parts = [], []
        last, words_y = None, set()
        for tx, ty, hx, hy in zip(xs, ys, shingle_sets(xs), shingle_sets(ys), strict=True):
            h = np.sort(np.concatenate([hx, hy]))
            twice = np.concatenate([h[1:] == h[:-1], [False]])
            parts.append(h[~(twice | np.concatenate([[False], twice[:-1]]))])
            if 9 * len(parts[-1]) > len(hx) + len(hy):
                linked.append(False)
                continue
            ty = ty.as_py()
            if ty != last:
                last, words_y = ty, word_shingles(ty)
            words_x = word_shingles(tx.as_py())
            both = len(words_x & words_y)
            linked.append(100 * both >= 80 * (len(words_x) + len(words_y) - both))
        return pa.StructArray.from_arrays([pa.array(linked, pa.bool_()), _long_lists(parts)], ["linked", "difference"])

    return arrow_udf(compared, "struct<linked: boolean, difference: array<long>>")(x, y)


def _heavy(texts: DataFrame, fine: frozenset[int]) -> DataFrame:
    """sig, heavy (estimated rows) of signatures that would fill a task by themselves, found on one document in HEAVY_SAMPLE. Bounded by HEAVY_MOST rows."""
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(HEAVY_SAMPLE)) == 0)
    sample = stored(sample.select(F.explode(_signature_column(F.col("text"), fine)).alias("sig")).groupBy("sig").count(), "heavy")
    total = sample.agg(F.sum("count")).first()[0] or 0
    return sample.where(F.col("count") >= max(HEAVY_LEAST, total // HEAVY_MOST)).select("sig", (F.col("count") * HEAVY_SAMPLE).alias("heavy"))


def _shared(texts: DataFrame, classes: DataFrame, copies: DataFrame, n_copies: int, fine: frozenset[int]) -> DataFrame:
    """For each class the signatures that other classes have too, with their cost; `typical` is the mean number of owners, negated: less is more typical."""
    signed = texts.join(small(copies, n_copies), "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), _signature_column(F.col("text"), fine).alias("signatures"))
    rows = signed.select("doc", F.explode("signatures").alias("sig"))
    rows = rows.join(F.broadcast(_heavy(texts, fine)), "sig", "left")
    salt = F.when(F.col("heavy").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc"), F.lit(HEAVY_SALTS)))
    bucket = Window.partitionBy("sig", "salt")
    rows = rows.withColumn("salt", salt.cast("int")).withColumn("cost", F.coalesce("heavy", F.count(F.lit(1)).over(bucket)))
    rows = rows.withColumn("alone", F.min("doc").over(bucket) == F.max("doc").over(bucket))
    rows = rows.where(F.col("heavy").isNotNull() | ~F.col("alone"))
    shared = rows.groupBy("doc").agg(F.collect_set(F.struct("cost", "sig")).alias("shared"))
    shared = shared.join(classes.select(F.col("rep").alias("doc"), "n_shingles", "parity", "n_own", "n_below"), "doc")
    n = F.col("n_own") + F.col("n_below")
    owners = F.aggregate("shared", F.lit(0.0), lambda acc, x: acc + x["cost"]) + (n - F.size("shared"))
    return stored(shared.withColumn("typical", -owners / n), "shared")


def _picked(shared: DataFrame) -> DataFrame:
    """The cheapest signatures of each class, in its own band and the one below, as many as the pigeonhole needs."""
    size, n_own, n_below = F.col("n_shingles"), F.col("n_own"), F.col("n_below")
    for name, parity in (("own", F.col("parity")), ("below", 1 - F.col("parity"))):
        shared = shared.withColumn(name, _of_parity(F.col("shared"), parity))
    need = F.floor((size + F.floor(size * 5 / 4)) / 9) + 1
    need_below = F.floor((2 * size - 1) / 9) + 1
    own = F.when(size <= TINY, F.size("own")).otherwise(F.greatest(F.lit(0), need - n_own + F.size("own"))).cast("int")
    below = F.when(size == TINY + 1, F.size("below")).otherwise(F.greatest(F.lit(0), need_below - n_below + F.size("below"))).cast("int")
    out = shared.select(
        "doc", size.alias("size"), "typical",
        F.slice("own", 1, own)["sig"].alias("own"), (n_own - F.size("own")).alias("own_alone"), "n_own",
        F.slice("below", 1, below)["sig"].alias("below"), (n_below - F.size("below")).alias("below_alone"), "n_below",
    )
    return stored(out.where("size(own) + size(below) > 0"), "picked")


def _of_parity(shared: Column, parity: Column) -> Column:
    return F.sort_array(F.filter(shared, lambda x: x["sig"].bitwiseAND(1) == parity))


def _exploded(picked: DataFrame) -> DataFrame:
    """doc, size, typical, sig, position among the n signatures of its band, for each picked signature."""
    parts = [picked.select("doc", "size", "typical", F.posexplode(k).alias("i", "sig"), F.col(f"{k}_alone").alias("alone"), F.col(f"n_{k}").alias("n")) for k in ("own", "below")]
    return parts[0].union(parts[1]).select("doc", "size", "typical", "sig", (F.col("alone") + F.col("i") + 1).alias("position"), "n")


def _pivots(shared: DataFrame, picked: DataFrame) -> DataFrame:
    """doc, size, pivot, pivot_size for classes with picked signatures: the set that is the most typical owner of most of a class's shared signatures.

    The owners of a signature are cut into parts by its cost, which all of them know, and each part gets the signature's head.
    """
    owners = shared.select("doc", "typical", F.col("n_shingles").alias("size"), F.explode("shared").alias("s")).select("doc", "typical", "size", "s.*")
    parts = F.ceil(F.col("cost") / OWNERS_PER_TASK).cast("int")
    heads = owners.groupBy("sig", "cost").agg(F.min(F.struct("typical", "doc", "size")).alias("head")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = owners.join(picked.select("doc"), "doc", "left_semi").withColumn("part", F.pmod(F.xxhash64("doc"), parts).cast("int")).join(heads, ["sig", "cost", "part"])
    votes = rows.groupBy("doc", "size", F.col("head.typical").alias("typical"), F.col("head.doc").alias("pivot"), F.col("head.size").alias("pivot_size")).count()
    best = votes.groupBy("doc").agg(F.max(F.struct("count", -F.col("typical"), "pivot", "pivot_size", "size")).alias("b"))
    return stored(best.select("doc", "b.size", "b.pivot", "b.pivot_size"), "pivots")


def _compared(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (x, y, ...) with `linked` and `difference`. The texts of a y in many pairs are met by its pairs in parts."""
    ids, n_pairs = texts.select(F.col("doc_id").alias("id"), "text"), pairs.count()
    left = ids.join(small(pairs, n_pairs), F.col("id") == F.col("x")).drop("id").withColumnRenamed("text", "text_x")
    of_y = stored(pairs.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "compared-with")
    right = ids.join(small(of_y.select("y"), n_pairs), F.col("id") == F.col("y")).select("y", F.col("text").alias("text_y"))
    met = hot_join(left, right, ["y"], any_hot(of_y, ["y"], n_pairs), F.col("x"))
    return met.withColumn("c", _comparison(F.col("text_x"), F.col("text_y"))).drop("text_x", "text_y").select(*pairs.columns, "c.*")


def _apart(rows: DataFrame, keys: list[str], columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Two sides (columns named _x and _y) of the pairs of rows (keys, doc, label, ...) that meet in a bucket and are of different labels, and the buckets that fill a task.

    One side has only the rows outside their bucket's most common label, the other has all, so a bucket that is nearly one component makes few pairs. Buckets of one label are left out.
    """
    rows = stored(rows, "in-buckets")
    labels = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    buckets = labels.groupBy(*keys).agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    buckets = stored(buckets, "buckets")
    large = any_hot(buckets, keys, buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    met = stored(hot_join(rows, buckets.select(*keys, "common"), keys, large, F.col("doc")), "met")
    released(rows)
    side = lambda df, of: df.select(*keys, F.col("doc").alias(of), *[F.col(c).alias(f"{c}_{of}") for c in columns], (F.col("label") != F.col("common")).alias(f"rare_{of}"))
    return side(met.where("label <> common"), "x"), side(met, "y"), large


def _met(rows: DataFrame, keys: list[str], columns: tuple[str, ...], may_link: Column) -> DataFrame:
    """x, y, size_x, size_y of the pairs of rows of a bucket and of different labels for which may_link holds."""
    x, y, large = _apart(rows, keys, (*columns, "size", "label"))
    near = (5 * F.col("size_x") >= 4 * F.col("size_y")) & (5 * F.col("size_y") >= 4 * F.col("size_x"))
    once = (F.col("x") < F.col("y")) | ~F.col("rare_y")
    return hot_join(y, x, keys, large, F.col("y")).where((F.col("label_x") != F.col("label_y")) & once & near & may_link).select("x", "y", "size_x", "size_y")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("label", "doc")).drop("node")


def _within_pivot(checked: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs x, y of one pivot and of different components that may link.

    With differences X and Y from the pivot, the pair differs in |X| + |Y| - 2 |X & Y|, so it shares (|X| + |Y| - H) / 2 elements of X and Y at least, and the rarest one they share
    stands early enough in both. What no partner could make enough of is dropped before rows meet: a partner has |X| - H elements at least, and H is at most (size + 5/4 size) / 9.
    """
    open_pivots = checked.where("not linked").select("pivot").distinct()
    rows = checked.where("pivot <> doc").join(small(open_pivots, open_pivots.count()), "pivot", "left_semi").withColumn("n", F.size("difference"))
    elements = stored(rows.select("pivot", "doc", "size", "n", F.explode("difference").alias("element")), "elements")
    counts = stored(elements.groupBy("pivot", "element").agg(F.count(F.lit(1)).alias("cost")), "costs")
    large = any_hot(counts, ["pivot", "element"], elements.count(), "cost")
    ordered = hot_join(elements, counts, ["pivot", "element"], large, F.col("doc")).groupBy("pivot", "doc", "size", "n")
    ordered = ordered.agg(F.sort_array(F.collect_set(F.struct("cost", "element"))).alias("order"))
    most = F.floor((F.col("size") + F.floor(5 * F.col("size") / 4)) / 9)
    least_shared = (F.col("n") + F.greatest(F.lit(1), F.col("n") - most) - most) / 2
    early = F.greatest(F.lit(0), F.floor(F.col("n") + 1 - least_shared)).cast("int")
    early = ordered.select("pivot", "doc", "size", "n", F.posexplode(F.slice("order", 1, early)).alias("i", "e")).where("e.cost > 1")
    early = _labelled(early.select("pivot", "doc", "size", "n", (F.col("i") + 1).alias("i"), F.col("e.element").alias("element")), label)
    room = 1 + F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
    needed = F.col("n_x") + F.col("n_y") - F.floor((F.col("size_x") + F.col("size_y")) / 9)
    found = _met(early, ["pivot", "element"], ("n", "i"), 2 * room >= needed)
    released(elements, counts)
    return found


def _across_pivots(picked: DataFrame, pivots: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs x, y of different pivots and components that share a picked signature early enough to link."""
    rows = _exploded(picked.join(pivots.select("doc"), "doc", "left_semi"))
    rows = _labelled(rows.join(pivots.select("doc", "pivot"), "doc"), label).drop("typical")
    most = F.floor((F.col("size_x") + F.col("size_y")) / 9)
    room = 1 + F.least(F.col("n_x") - F.col("position_x"), F.col("n_y") - F.col("position_y"))
    fits = (F.greatest("size_x", "size_y") <= TINY + 1) | (room >= F.greatest("n_x", "n_y") - most)
    return _met(rows, ["sig"], ("pivot", "position", "n"), fits & (F.col("pivot_x") != F.col("pivot_y")))


def _against_pivots(texts: DataFrame, pivots: DataFrame) -> DataFrame:
    """doc, pivot, size, linked, difference of every class and its pivot."""
    pairs = pivots.where("doc <> pivot").select(F.col("doc").alias("x"), F.col("pivot").alias("y"), "size")
    checked = _compared(texts, pairs).select(F.col("x").alias("doc"), F.col("y").alias("pivot"), "size", "linked", "difference")
    return stored(checked, "checked", "zstd")


def _numbered(docs: DataFrame) -> DataFrame:
    """row (a number of its own for every row of docs) and doc (a struct of all columns of docs). All links are between rows, so ids may be null or repeat."""
    bounded_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), whole), "numbered", "zstd")


def _row_components(rows: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component (the least row of those reachable by links, or of the class; its own for a row without words)."""
    rows = rows.select("row", "doc.doc_id", F.col("doc.text").cast("binary").alias("text"))
    texts = rows.select(F.col("row").alias("doc_id"), "text")
    described = lambda of: stored(rows.select("row", "doc_id", _class_column(F.col("text"), of).alias("c")).select("row", "doc_id", "c.*"), "members")
    members = described(frozenset())
    fine = frozenset(r[0] for r in members.select(F.explode("poor")).distinct().collect())  # numbers of bands: one a doubling of the size
    if fine:
        released(members)
        members = described(fine)
    worded, n_rows = members.where("n_shingles > 0"), members.count()
    classes = worded.groupBy("digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("n_shingles", "parity", "n_own", "n_below")])
    classes = stored(classes, "classes")
    large = any_hot(classes, ["digest"], n_rows)
    copies = hot_join(worded.select("row", "digest"), classes.where("n > 1").select("digest", "rep"), ["digest"], large, F.col("row"))
    copies = stored(copies.where("row <> rep").select(F.col("row").alias("doc_id")), "copies")
    shared = _shared(texts, classes, copies, copies.count(), fine)
    released(copies)
    picked = _picked(shared)
    pivots = _pivots(shared, picked)
    checked = _against_pivots(texts, pivots)
    alone = checked.where("not linked").select("doc")
    second = _pivots(shared.join(alone, "doc", "left_semi"), picked.join(alone, "doc", "left_semi"))
    again = _against_pivots(texts, second)
    released(shared, second)
    found = checked.where("linked").select("doc", "pivot").union(again.where("linked").select("doc", "pivot"))
    label = stored(components(found.select(F.col("doc").alias("u"), F.col("pivot").alias("v"))), "labels")
    released(again)
    more = _within_pivot(checked, label).union(_across_pivots(picked, pivots, label))
    more = stored(more.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "more")
    released(checked, picked, pivots)
    links = _compared(texts, more).where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    links = links.join(label.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u", "left").join(label.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v", "left")
    joined = components(links.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")))
    joined = joined.select(F.col("node").alias("old"), F.col("label").alias("new"))
    of = classes.select("digest", "rep").join(label, F.col("rep") == F.col("node"), "left").withColumn("at", F.coalesce("label", "rep")).join(joined, F.col("at") == F.col("old"), "left")
    of = stored(of.select("digest", F.coalesce("new", "at").alias("component")), "of-class")
    released(label, more)
    columns = ["row", "doc_id", "n_shingles", "component"]
    placed = hot_join(worded.select("row", "doc_id", "n_shingles", "digest"), of, ["digest"], large, F.col("row")).select(*columns)
    return stored(placed.union(members.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("row").alias("component"))), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text); other columns are ignored.

    Texts of equal words are one class and are compared once. Null, empty and blank texts have no shingles and are components of their own. Links are between
    rows: rows that repeat a doc_id are classed by their own texts, and rows without doc_id link like others; component_id is the least doc_id of the component, null if none of its rows has one.
    """
    rows = _row_components(_numbered(docs.select("doc_id", "text")))
    per = stored(rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "component-ids")
    found = hot_join(rows, per.select("component", "component_id"), ["component"], hot(per, ["component"], rows.count()), F.col("row"))
    return found.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of docs (doc_id, text, ...), with all its columns: that of least doc_id (null last), then of least number in the order of reading."""
    rows = _numbered(docs)
    first = _row_components(rows).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")).select("row")
    first = stored(first, "first")
    return rows.join(small(first, first.count()), "row", "left_semi").select("doc.*")


#: The same classes by counting the shared shingles of all pairs, for comparison on small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s0 AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS k FROM s0),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM c JOIN z a ON a.doc_id = u JOIN z b ON b.doc_id = v WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
least_of AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN z USING (doc_id) LEFT JOIN least_of ON least_of.u = d.doc_id
"""
