"""Centroid clustering: exact k-means whose distances are first bounded in an n-simplex space.

Some pivots, apart from each other, span a simplex. The distances of a vector to all pivots fix one more corner over that simplex: its apex, which has a
coordinate for each edge from the first pivot and the altitude over their span. Of two apexes the Euclidean distance is a lower bound of the distance of the vectors, and the distance with
one altitude turned down is an upper bound. Distances to pivots are computed once a vector and kept beside it; every round turns them into apexes, bounds the
distance to all centroids with a few coordinates, and compares exactly, in integers, only centroids whose lower bound isn't above the least upper bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import bounded_batches, released, stored
from shelfcast.llm.vectors import Sums, digest, is_whole, lists, matrix, scaled, squared, squared_rows, summed

CLUSTERS, ROUNDS, SCALE, WIDTH, PIVOTS = 16, 3, 64, 64, 12
#: A pivot's altitude over the span of the others is at least this share of the longest edge, so that the triangular system stays well conditioned.
LEAST_ALTITUDE = 1e-3
#: Share of the distances involved by which bounds may be off by rounding.
SLACK = 1e-5


@dataclass
class Simplex:
    """Pivots and the lower triangular coordinates of all but the first, which is the origin."""

    pivots: np.ndarray
    corners: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, most: int = PIVOTS) -> Simplex:
        """The first point, then time after time the point farthest from the span of those chosen."""
        chosen, rest = [0], (points - points[0]).astype(float)
        edge, basis = np.sqrt((rest**2).sum(1).max(initial=0)), []
        while len(chosen) < most:
            altitude = np.sqrt((rest**2).sum(1))
            i = int(altitude.argmax())
            if altitude[i] <= LEAST_ALTITUDE * edge or altitude[i] == 0:
                break
            chosen.append(i)
            basis.append(rest[i] / altitude[i])
            rest = rest - np.outer(rest @ basis[-1], basis[-1])
        pivots = points[chosen]
        corners = (pivots[1:] - pivots[0]).astype(float) @ np.array(basis).T if basis else np.zeros((0, 0))
        return cls(pivots, np.tril(corners))

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates over the span, then the altitude, from squared distances to the pivots."""
        d = distances.astype(float)
        sides = (d[:, :1] + (self.corners**2).sum(1)[None, :] - d[:, 1:]) / 2
        at = np.zeros_like(sides)
        for k in range(sides.shape[1]):
            at[:, k] = (sides[:, k] - at[:, :k] @ self.corners[k, :k]) / self.corners[k, k]
        altitude = np.sqrt(np.maximum(0.0, d[:, 0] - (at**2).sum(1)))
        return np.column_stack([at, altitude])


def possible(apexes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each vector's apex, which centroids (apexes `of`) may be nearest: those whose lower bound isn't above the least upper bound."""
    squares = (apexes**2).sum(1)[:, None] + (of**2).sum(1)[None, :]
    flat = squares - 2 * (apexes[:, :-1] @ of[:, :-1].T)
    turned = 2 * apexes[:, -1:] * of[None, :, -1]
    lower, upper = np.sqrt(np.maximum(0.0, flat - turned)), np.sqrt(np.maximum(0.0, flat + turned))
    slack = SLACK * (np.sqrt(squares.max(1)) + 1)
    return lower <= (upper.min(1) + slack)[:, None]


def nearest(v: np.ndarray, distances: np.ndarray, simplex: Simplex, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, the smaller number on a tie; and how many distances were computed in full."""
    may = possible(simplex.apexes(distances), simplex.apexes(squared(centroids, simplex.pivots)))
    best, at = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero(may[:, c])
        d = squared_rows(v[rows], centroids[c][None, :])
        better = d < best[rows]
        best[rows[better]], at[rows[better]] = d[better], c
    return at, best, int(may.sum())


def _measured(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """kept, v and `distances`: squared distances to the pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column("kept"), b.column("v"), lists(squared(matrix(b.column("v")), simplex.pivots), pa.int64())], ["kept", "v", "distances"])

    schema = vectors.select("kept", "v", F.lit(None).cast("array<long>").alias("distances")).schema
    return vectors.select("kept", "v").mapInArrow(measure, schema)


def _sums(measured: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Sums(0, *centroids.shape)
        for b in batches:
            if len(b):
                v = matrix(b.column("v"))
                code, d, _ = nearest(v, matrix(b.column("distances")), simplex, centroids)
                seen.add(code, v, d)
        yield seen.batch()

    return measured.select("v", "distances").mapInArrow(add, Sums.SCHEMA)


def _placed(measured: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                code, d, _ = nearest(matrix(b.column("v")), matrix(b.column("distances")), simplex, centroids)
                yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(code.astype(np.int32)), pa.array(d)], ["kept", "cluster", "distance"])

    schema = measured.select("kept", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).schema
    return measured.mapInArrow(place, schema)


def cluster_vectors(rows: DataFrame, keep: tuple[str, ...] = ("vec_id",), clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """kept (a struct of the columns `keep`), cluster int, distance long for every row of `rows` (vec_id, embedding) with a whole vector of `width` components; and the final centroids.

    Other rows are left out. A vector with a component too large for exact 64-bit distances stays with null cluster and distance. The first centroids are the
    vectors whose sha256 of `1:<vec_id>` is least (a null id comes last, equal ids go by their components); with fewer vectors there are fewer clusters.
    Empty clusters stay where they are. An empty table gives an empty result.
    """
    bounded_batches(rows.sparkSession)
    whole = rows.where(is_whole(F.col("embedding")) & (F.size("embedding") == width))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    base = stored(whole.select(kept, order.alias("h"), scaled(F.col("embedding"), scale).alias("v")), "cluster-vectors")
    fits = base.where("v is not null")
    odd = base.where("v is null").select("kept", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    start = fits.orderBy(F.col("h").asc_nulls_last(), "v").select("v").limit(clusters).collect()
    if not start:
        return odd, np.zeros((0, width), np.int64)
    centroids = np.array([r[0] for r in start], np.int64)
    simplex = Simplex.over(centroids, pivots)
    measured = stored(_measured(fits, simplex), "cluster-distances")
    for _ in range(rounds):
        sums = _sums(measured, simplex, centroids)
        centroids = centroids.copy()
        for _, code, n, _, total in summed(sums, width):
            centroids[code] = [s // n for s in total]
    placed = stored(_placed(measured, simplex, centroids), "clusters")
    released(measured)
    return placed.unionByName(odd), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256: a value a cluster, which are few."""
    per = {r[0]: r[1] for r in found.where("cluster is not null").groupBy("cluster").agg(F.sum("distance")).collect()}
    hashes = [hashlib.sha256(digest(c).encode()).hexdigest() for c in centroids]

    def of(values: list, kind: str) -> Column:
        return F.try_element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)

    inertia = F.lit(sum(per.values()) if per else None).cast("long")
    return found.select("*", of([per.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"), inertia.alias("inertia"), of(hashes, "string").alias("centroid_sha256"))


#: The same rounds by comparing every vector with every centroid.
ORACLE_ROUND = """
a{i} AS MATERIALIZED (SELECT p.vec_id, min(CAST(p.xx + c.xx - 2 * list_inner_product(p.v, c.x) AS BIGINT) * 16 + num) AS best FROM p, c{i} AS c GROUP BY p.vec_id),
s{i} AS (SELECT num, k, CAST(sum(v[k]) AS BIGINT) AS s, count(*) AS n FROM (SELECT best % 16 AS num, v, unnest(range(1, 65)) AS k FROM a{i} AS a JOIN p ON a.vec_id = p.vec_id) AS u GROUP BY num, k),
n{i} AS (SELECT num, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY k) AS x FROM s{i} GROUP BY num),
c{j} AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT c.num, coalesce(n.x, c.x) AS x FROM c{i} AS c LEFT JOIN n{i} AS n ON c.num = n.num) AS u),"""
ORACLE = f"""
WITH p AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS xx FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS u),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS num, v AS x, xx FROM p QUALIFY num < 16),
{"".join(ORACLE_ROUND.format(i=i, j=i + 1) for i in range(3)).strip()}
a3 AS (SELECT p.vec_id, min(CAST(p.xx + c.xx - 2 * list_inner_product(p.v, c.x) AS BIGINT) * 16 + num) AS best FROM p, c3 AS c GROUP BY p.vec_id),
h AS (SELECT num, sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY k)) AS centroid_sha256 FROM (SELECT num, unnest(x) AS y, unnest(range(1, 65)) AS k FROM c3) AS u GROUP BY num)
SELECT vec_id, CAST(best % 16 AS INT) AS cluster, best // 16 AS distance, CAST(sum(best // 16) OVER (PARTITION BY best % 16) AS BIGINT) AS cluster_inertia, CAST(sum(best // 16) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN h ON h.num = best % 16
"""
