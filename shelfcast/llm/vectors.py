"""Integer vectors, exact distances and sums by code, shared by the clustering operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_whole(c: Column) -> Column:
    """Whether a vector is there and holds neither null nor NaN nor infinite components."""
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def scaled(c: Column, scale: int) -> Column:
    """floor(scale * x) of every component of a whole vector, or null if one is so large that four times a squared distance could pass 64 bits."""
    wide = F.transform(c, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    most = F.sqrt(F.lit(2.0**59) / F.greatest(F.size(c), F.lit(1)))
    within = F.forall(c, lambda x: F.abs(x.cast("double")) * F.lit(float(scale)) <= F.least(most, F.lit(2.0**30)))
    return F.when(within, wide.cast("array<int>"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(values.ravel(), kind))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a to the rows of b: in doubles where every sum stays below 2^53, else in 64-bit integers."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if 4 * int(most) ** 2 * a.shape[1] < 2**53:
        a, b = a.astype(float), b.astype(float)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def squared_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of a to the same row of b."""
    diff = a - b
    return np.einsum("ij,ij->i", diff, diff)


class Sums:
    """Component sums, counts and the largest distance by code, of all rows that a task has seen: one row a code leaves the task."""

    SCHEMA = "part int, code int, n long, farthest long, sums array<long>"

    def __init__(self, part: int, codes: int, width: int) -> None:
        self.part, self.n, self.farthest, self.sums = part, np.zeros(codes, np.int64), np.zeros(codes, np.int64), np.zeros((codes, width), np.int64)

    def add(self, code: np.ndarray, values: np.ndarray, distance: np.ndarray) -> None:
        order = np.argsort(code, kind="stable")
        met, first = np.unique(code[order], return_index=True)
        if len(met):
            self.n[met] += np.diff(np.append(first, len(code)))
            self.sums[met] += np.add.reduceat(values[order], first, axis=0)
            self.farthest[met] = np.maximum(self.farthest[met], np.maximum.reduceat(distance[order], first))

    def batch(self) -> pa.RecordBatch:
        met = np.flatnonzero(self.n)
        part = np.full(len(met), self.part, np.int32)
        return pa.record_batch([pa.array(part), pa.array(met.astype(np.int32)), pa.array(self.n[met]), pa.array(self.farthest[met]), lists(self.sums[met], pa.int64())], ["part", "code", "n", "farthest", "sums"])


def summed(sums: DataFrame, width: int) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(part, code, n, farthest, sums) of all tasks together: one row a part and code, a number that the operator's parameters bound."""
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    for r in sums.groupBy("part", "code").agg(F.sum("n"), F.max("farthest"), *each).collect():
        yield r[0], r[1], r[2], r[3], list(r[4:])


def digest(numbers: np.ndarray) -> str:
    """The decimal integers of an array in order, joined by commas."""
    return ",".join(map(str, numbers.ravel().tolist()))
