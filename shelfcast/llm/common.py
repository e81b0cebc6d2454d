"""Pieces that several corpus operators share.

Texts are handled as UTF-8 bytes. `words_of` and `plain_words` split one text; `spans` splits a whole Arrow
batch at once with numpy and never lets a word cross the border of two texts.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import prepare

_SPACE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")
_UPPER = bytes(range(65, 91))
#: Lower-cases A-Z and turns every byte outside 0-9, a-z and the non-ASCII range into a space.
_LETTERS = bytes(c + 32 if c in _UPPER else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LOWER = np.array([c + 32 if c in _UPPER else c for c in range(256)], np.uint8)
IS_SPACE = np.array([c in _SPACE for c in range(256)])
#: Narrow tables (ids, sources) of up to so many rows are broadcast.
BROADCAST_ROWS = 500_000
BATCH_BYTES = 2 << 20
#: A key of so many rows may be cut into parts; at most so many keys are.
HOT_ROWS, HOT_KEYS = 1_000, 100_000
_own_folder: dict[str, str] = {}
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters; a null text has none."""
    return text.translate(_LETTERS).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a folder of this run on a local master; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and a lost executor costs no recomputation of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(_path_of.pop(t))
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at BATCH_BYTES, so a Python worker's memory follows its longest texts and not a count of rows. Workers find this package."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has few rows; a longer one is left to a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _hot_from(total: int) -> int:
    return max(HOT_ROWS, -(-total // HOT_KEYS))


def hot(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """Of counts (keys, n), one row a key, the keys of so many rows that they would fill a task, with `parts`, into how many pieces their rows are to be cut.

    A key is hot from HOT_ROWS rows or a HOT_KEYS-th of all rows on, so there are at most HOT_KEYS of them, and they are broadcast.
    """
    least = _hot_from(total)
    return F.broadcast(counts.where(F.col(n) >= least).select(*keys, F.ceil(F.col(n) / (least / 2)).cast("int").alias("parts")))


def any_hot(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame | None:
    """hot(), or None if no key is hot. One more pass over counts, which should be stored; it spares the plans that follow two broadcasts a join."""
    most = counts.agg(F.max(n)).first()[0] or 0
    return hot(counts, keys, total, n) if most >= _hot_from(total) else None


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], hot_keys: DataFrame | None, spread: Column, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """rows joined with table (one row a key). The rows of a hot key are cut by `spread` into its parts, each of which meets a copy of the key's row in table.

    `by` names the columns of hot_keys, where they aren't all of `keys`. Without hot keys (None) it is a plain join.
    """
    if hot_keys is None:
        return rows.join(table, keys, how)
    by = by or keys
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("parts")).cast("int"), F.lit(0))
    left = rows.join(hot_keys, by, "left").withColumn("__part", part).drop("parts")
    right = table.join(hot_keys, by, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def in_struct(docs: DataFrame, *named: str) -> DataFrame:
    """All columns of docs as the struct `doc`, and beside it the columns `named`: whatever else docs has, no name clashes with those of an operator."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(whole, *[F.col(f"`{c}`") for c in named])


def slices(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `limit` bytes (one row at least), each with its bytes and its rows' offsets in them. Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield start, end, data[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


def spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that `gap` doesn't mark; a run never crosses a row's border."""
    inside = ~gap[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = off[(off > 0) & (off < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 19)
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
        del _powers[:-2]
    return _powers[0], _powers[1]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same wherever the run stands."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
