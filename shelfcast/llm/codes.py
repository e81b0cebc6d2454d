"""Vector code compression: product codebooks learned by exact ball k-means.

A vector is cut into parts, and each part position has a codebook of entries. The parts assigned to an entry form its ball, whose radius is the distance of
the farthest of them. For a part x in the ball of entry i another entry j can only be as near as i if |c_i c_j| <= 2 |x c_i| (triangle inequality). So in a round

* the neighbours of i are the entries with |c_i c_j| <= 2 radius; all others can't take anything from the ball,
* a ball is left alone, with its codes and distances, where neither its entry nor a neighbour has moved,
* in other balls the parts of the stable core (half the way to the nearest neighbour) keep their code after one distance,
* a part further out lies in a ring between half the distances to two neighbours and is compared with the neighbours inside that ring, exactly.

The radius after entries moved is bounded by the old radius and the way that the entry went, so each round is one pass: codes and distances are written with
the vectors, and a task sends one row of sums a part and entry. All comparisons are of integers; equal distances go to the lower index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shelfcast.llm.common import HOT_ROWS, bounded_batches, hot, hot_join, released, small, stored
from shelfcast.llm.vectors import Sums, digest, is_whole, lists, matrix, scaled, squared, squared_rows, summed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Neighbours that are compared at a time.
RING = 64


@dataclass
class Balls:
    """The entries of one part position and what a round knows about their balls."""

    entries: np.ndarray
    #: For each ball: its neighbours, nearest first, the squared distances to them, and whether its parts have to be looked at.
    neighbours: list[np.ndarray]
    apart: list[np.ndarray]
    active: np.ndarray


def make_balls(entries: np.ndarray, before: np.ndarray, farthest: np.ndarray) -> Balls:
    """Balls of entries that stood at `before` when the farthest of their parts had the squared distance `farthest`."""
    moved = squared_rows(entries, before)
    ceil = lambda n: math.isqrt(n) + (math.isqrt(n) ** 2 < n)
    reach = [4 * (ceil(int(f)) + ceil(int(m))) ** 2 for f, m in zip(farthest, moved, strict=True)]
    between = squared(entries, entries)
    neighbours, apart, active = [], [], np.zeros(len(entries), bool)
    for i, limit in enumerate(reach):
        order = np.argsort(between[i], kind="stable")
        near = order[(between[i][order] <= min(limit, 2**63 - 1)) & (order != i)]
        neighbours.append(near)
        apart.append(between[i][near])
        active[i] = moved[i] > 0 or bool((moved[near] > 0).any())
    return Balls(entries, neighbours, apart, active)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry, the lower index on a tie: the first round, when there are no balls yet."""
    d = squared(x, entries)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def reassign(x: np.ndarray, code: np.ndarray, distance: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """New codes and squared distances of parts x, and how many distances to entries were computed."""
    code, distance, work = code.copy(), distance.copy(), 0
    rows = np.flatnonzero(balls.active[code])
    distance[rows] = squared_rows(x[rows], balls.entries[code[rows]])
    work += len(rows)
    rows = rows[np.argsort(code[rows], kind="stable")]
    met, first = np.unique(code[rows], return_index=True)
    for i, a, b in zip(met, first, np.append(first[1:], len(rows)), strict=False):
        own = rows[a:b]
        near, apart = balls.neighbours[i], balls.apart[i]
        inner = np.searchsorted(apart, 4 * distance[own], "right")  # neighbours within the part's ring; none for the stable core
        own, inner = own[inner > 0], inner[inner > 0]
        order = np.argsort(-inner, kind="stable")
        own, inner = own[order], inner[order]
        best, at = distance[own], np.full(len(own), i)
        for k in range(0, len(near), RING):
            n = int(np.searchsorted(-inner, -k, "left"))  # parts whose ring goes beyond the first k neighbours
            if n == 0:
                break
            some = np.sort(near[k : k + RING])
            d = squared(x[own[:n]], balls.entries[some])
            work += d.size
            j = d.argmin(1)
            least, which = d[np.arange(n), j], some[j]
            better = (least < best[:n]) | ((least == best[:n]) & (which < at[:n]))
            best[:n], at[:n] = np.where(better, least, best[:n]), np.where(better, which, at[:n])
        code[own], distance[own] = at, best
    return code, distance, work


def _cut(v: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(v, parts, axis=1)


def _assigned(state: DataFrame, books: list[np.ndarray], balls: list[Balls] | None) -> DataFrame:
    """state (kept, v, codes, distances) with the codes and distances of the present codebooks."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _cut(matrix(b.column("v")), len(books))
            if balls is None:
                found = [nearest(p, book) for p, book in zip(x, books, strict=True)]
            else:
                code, distance = matrix(b.column("codes")), matrix(b.column("distances"))
                found = [reassign(p, code[:, i], distance[:, i], balls[i]) for i, p in enumerate(x)]
            codes, distances = (np.column_stack([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("kept"), b.column("v"), lists(codes, pa.int32()), lists(distances, pa.int64())], ["kept", "v", "codes", "distances"])

    return state.mapInArrow(assign, state.schema)


def _sums(state: DataFrame, books: list[np.ndarray]) -> DataFrame:
    sizes = [book.shape for book in books]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Sums(i, *size) for i, size in enumerate(sizes)]
        for b in batches:
            codes, distances = matrix(b.column("codes")), matrix(b.column("distances"))
            for i, x in enumerate(_cut(matrix(b.column("v")), len(sizes)) if len(codes) else []):
                seen[i].add(codes[:, i], x, distances[:, i])
        yield from (s.batch() for s in seen)

    return state.select("v", "codes", "distances").mapInArrow(add, Sums.SCHEMA)


def usual_length(vectors: DataFrame, parts: int) -> int | None:
    """The most common length of v that can be cut into `parts`, the shorter one on a tie; None without such vectors."""
    n = F.size("v")
    row = vectors.where((n > 0) & (n % parts == 0)).groupBy(n.alias("d")).count().agg(F.max_by("d", F.struct("count", -F.col("d")))).first()
    return row[0]


def compress(rows: DataFrame, keep: tuple[str, ...] = ("vec_id", "label"), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """kept (a struct of the columns `keep`), codes array<int>, error long for every row of `rows` (vec_id, embedding) with a whole vector; and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out. A vector of another length than the usual one (see usual_length) or with a component too large for
    exact 64-bit distances stays with null codes and error. The first entries are the vectors of least vec_id (null last; equal ids by their components); with fewer vectors than
    `entries`, there are as many entries as vectors. Unused entries stay where they are. An empty table gives an empty result and codebooks without entries.
    """
    bounded_batches(rows.sparkSession)
    whole = rows.where(is_whole(F.col("embedding")))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    base = stored(whole.select(kept, F.col("vec_id").alias("id"), scaled(F.col("embedding"), scale).alias("v")), "code-vectors")
    length = usual_length(base, parts)
    fits = F.coalesce(F.size("v") == F.lit(length), F.lit(False)) if length else F.lit(False)
    odd = base.where(~fits).select("kept", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    if not length:
        return odd, [np.zeros((0, 0), np.int64)] * parts
    start = np.array([r[0] for r in base.where(fits).orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()], np.int64)
    books, balls, old = _cut(start, parts), None, None
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "array<int>"), ("distances", "array<long>"))]
    state = base.where(fits).select("kept", "v", *nothing)
    for _ in range(rounds):
        state = stored(_assigned(state, books, balls), "codes")
        if old is not None:
            released(old)
        old, before = state, books
        books, farthest = [b.copy() for b in before], [np.zeros(len(b), np.int64) for b in before]
        for part, code, n, far, sums in summed(_sums(state, before), length // parts):
            books[part][code] = [s // n for s in sums]
            farthest[part][code] = far
        balls = [make_balls(*x) for x in zip(books, before, farthest, strict=True)]
    final = stored(_assigned(state, books, balls).select("kept", "codes", F.aggregate("distances", F.lit(0).cast("long"), lambda a, x: a + x).alias("error")), "code-result")
    if old is not None:
        released(old)
    return final.unionByName(odd), books


def decoded(codes: Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector of entries that codes stand for, in the units of the embedding (each entry's component is the lower edge of its integer cell, so half a cell is added); null for null codes."""

    @arrow_udf("array<double>")
    def restore(codes: pa.Array) -> pa.Array:
        known = codes.drop_null()
        c = matrix(known)
        values = (np.hstack([b[c[:, i]] for i, b in enumerate(books)]) + 0.5) / scale if len(known) else np.zeros((0, 0))
        place = np.cumsum(np.array(codes.is_valid())) - 1
        return lists(values, pa.float64()).take(pa.array(place, mask=np.array(codes.is_null()))) if len(known) else pa.nulls(len(codes), pa.list_(pa.float64()))

    return restore(codes)


def code_text(codes: Column) -> Column:
    """Two lower-case hex digits a part; null for null codes."""
    return F.when(codes.isNotNull(), F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), ""))


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(digest(b) for b in books if b.size).encode()).hexdigest()


def with_label_errors(found: DataFrame, label: Column) -> DataFrame:
    """found with label_error, the error summed over all rows of an equal label (nulls together); a label's rows may be any share of all rows."""
    rows = found.select("*", label.isNull().alias("__none"), F.coalesce(label.cast("string"), F.lit("")).alias("__label"))
    keys = ["__none", "__label"]
    per = stored(rows.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    labels, total = per.agg(F.count(F.lit(1)), F.sum("n")).first()
    table = per.select(*keys, "label_error")
    marked = small(table, labels)
    if marked is not table:
        return rows.join(marked, keys).drop(*keys)
    return hot_join(rows, table, keys, hot(per, keys, max(total, HOT_ROWS)), F.col("kept")).drop(*keys)


#: The same rounds by comparing every part with every entry, for tables of vectors of one length.
ORACLE_ROUND = """
a{i} AS MATERIALIZED (SELECT vec_id, p.part, min(CAST(p.xx + c.xx - 2 * list_inner_product(p.x, c.x) AS BIGINT) * 256 + entry) AS best FROM p JOIN c{i} AS c ON p.part = c.part GROUP BY vec_id, p.part),
s{i} AS (SELECT part, entry, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p.part, best % 256 AS entry, x, unnest(range(1, len(x) + 1)) AS k FROM a{i} AS a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part) AS u GROUP BY part, entry, k),
n{i} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY k) AS x FROM s{i} GROUP BY part, entry),
c{j} AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{i} AS c LEFT JOIN n{i} AS n ON c.part = n.part AND c.entry = n.entry) AS u),"""
ORACLE = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM v, range(4) AS r(part)) AS u),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x, xx FROM p QUALIFY entry < 256),
{"".join(ORACLE_ROUND.format(i=i, j=i + 1) for i in range(4)).strip()}
a4 AS (SELECT vec_id, p.part, min(CAST(p.xx + c.xx - 2 * list_inner_product(p.x, c.x) AS BIGINT) * 256 + entry) AS best FROM p JOIN c4 AS c ON p.part = c.part GROUP BY vec_id, p.part),
f AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS k FROM c4) AS u)
SELECT f.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN v ON f.vec_id = v.vec_id, h
"""
