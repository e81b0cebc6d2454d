"""Line dedup by content-defined chunks and two-line windows.

Two families of pieces are compared. One is content-defined: a text is cut after a line where a rolling hash over the last lines' hashes falls on a boundary and did not
one line before, so cuts move with the content when lines are put in above. The other begins a window of two lines at every line, so that each adjacent
pair of lines is in a piece whatever surrounds it. A piece of two lines or more that occurs more than once in its family is kept at its first
place (least doc_id, then row, then place) and its lines are removed everywhere else. Windows that overlap extend each other line by line, so a repeated passage of two or more
lines goes as a whole. A line that repeats without a repeated neighbour stays, and every line stays at its first place. Blank lines are lines.
Hashes only nominate pieces; what is removed was equal byte for byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shelfcast.llm.common import bounded_batches, hot, hot_join, mixed, released, run_hashes, stored

#: Lines under the rolling hash, and one line in so many is a boundary. Chunks have no greatest length: a run of equal lines without a boundary is one chunk.
ROLL, AVERAGE = 2, 2


def chunks(text: bytes | None) -> list[tuple[int, int, int]]:
    """(first byte, byte after, lines) of each chunk; chunks follow each other and make up the text."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    after = np.flatnonzero(data == 10) + 1
    if not len(after) or after[-1] < len(data):
        after = np.append(after, len(data))
    first = np.concatenate([[0], after[:-1]])
    h = run_hashes(data, first, after)
    roll = h.copy()
    for back in range(1, ROLL):
        roll[back:] += h[:-back] * np.uint64(2 * back + 1)
    cut = mixed(roll) % np.uint64(AVERAGE) == 0
    cut[1:] &= ~cut[:-1].copy()
    cut[-1] = True
    last = np.flatnonzero(cut)
    begun = np.concatenate([[0], after[last[:-1]]])
    return list(zip(begun.tolist(), after[last].tolist(), np.diff(last, prepend=-1).tolist(), strict=True))


def _lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after (without the line feed) of each line."""
    feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    first, until = np.concatenate([[0], feeds + 1]), np.append(feeds, len(text))
    return (first[:-1], until[:-1]) if first[-1] == len(text) else (first, until)


def _pieces_of(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place (line), chunk lines (0: a window of two lines), first byte and byte after of each piece of two lines or more."""
    first, until = _lines(text) if text else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = np.array([lines for _, _, lines in chunks(text)], np.int64)
    begins = np.cumsum(n) - n
    begins, n = begins[n > 1], n[n > 1]
    windows = np.arange(max(0, len(first) - 1))
    place, chunk = np.concatenate([windows, begins]), np.concatenate([np.zeros(len(windows), np.int64), n])
    return place, chunk, first[place], until[place + np.maximum(chunk, 2) - 1]


def _hashed(texts: pa.Array) -> pa.Array:
    sizes, columns = [0], [[], [], []]
    for text in texts:
        text = text.as_py()
        place, chunk, a, b = _pieces_of(text)
        sizes.append(len(place))
        if len(place):
            for column, values in zip(columns, (place, chunk, run_hashes(np.frombuffer(text, np.uint8), a, b).view(np.int64)), strict=True):
                column.append(values)
    flat = [np.concatenate([np.zeros(0, np.int64), *column]) for column in columns]
    pieces = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2])], ["place", "chunk", "h"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pieces)


def _bytes(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    out = []
    for text, pieces in zip(texts, wanted, strict=True):
        text = text.as_py()
        first, until = (x.tolist() for x in _lines(text))
        out.append([p | {"bytes": text[first[p["place"]] : until[p["place"] + max(p["chunk"], 2) - 1]]} for p in pieces.as_py()])
    return pa.array(out, pa.list_(pa.struct([("place", pa.int32()), ("chunk", pa.int32()), ("bytes", pa.binary())])))


def _without(texts: pa.Array, places: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts, places, strict=True):
        text, gone = text.as_py(), gone.as_py() or []
        cuts = chunks(text)
        kept, drop = text, {i for p in gone for i in range(p["place"], p["place"] + max(p["chunk"], 2))}
        if drop:
            starts = [*_lines(text)[0].tolist(), len(text)]
            kept = b"".join(text[a:b] for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if i not in drop)
        out.append({"n_lines": sum(n for _, _, n in cuts), "n_chunks": len(cuts), "removed_lines": len(drop), "removed_chunks": sum(p["chunk"] > 0 for p in gone), "kept": None if kept is None else kept.decode("utf-8", "replace")})
    return pa.array(out, pa.struct([("n_lines", pa.int64()), ("n_chunks", pa.int64()), ("removed_lines", pa.int64()), ("removed_chunks", pa.int64()), ("kept", pa.string())]))


def _call(f, schema: str, *columns: Column) -> Column:
    return arrow_udf(f, schema)(*columns)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_chunks, removed_lines, removed_chunks, kept (the text without repeated passages) for every row of docs (doc_id, text).

    removed_chunks counts the content-defined chunks that repeat an earlier one. Null stays null and empty stays empty. The last line feed is not
    part of a piece's bytes, so a passage at the end of a text equals the same passage in the middle. All decisions are by a stored row id: rows that repeat a doc_id
    are documents of their own, in the order of their rows, and rows without doc_id come after all others. Counting is by hash
    with map-side partial sums, so a piece in a third of all texts stays one record a task, and its rows are cut into parts where they meet its count
    and its first place; the texts are shuffled only to meet their own pieces' decisions.
    """
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("binary")
    rows = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "line-texts", "zstd")
    hashed = rows.select("row", F.explode(_call(_hashed, "array<struct<place: int, chunk: int, h: long>>", text)).alias("p")).select("row", "p.*")
    hashed = stored(hashed, "line-hashes", "zstd")
    repeated = stored(hashed.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-repeats")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    wanted = hot_join(hashed, repeated.select("h", "chunk"), ["h", "chunk"], hot(repeated, ["h", "chunk"], total), F.col("row"), "left_semi")
    wanted = stored(wanted.groupBy("row").agg(F.collect_list(F.struct("place", "chunk")).alias("places")), "line-places", "zstd")
    released(hashed, repeated)
    pieces = rows.join(wanted.hint("merge"), "row").select("row", "doc_id", F.explode(_call(_bytes, "array<struct<place: int, chunk: int, bytes: binary>>", text, F.col("places"))).alias("p"))
    pieces = stored(pieces.select("row", "doc_id", "p.*", F.xxhash64("p.bytes").alias("h")), "line-bytes", "zstd")
    released(wanted)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "place"))
    same = ["h", "chunk", "bytes"]
    keep = stored(pieces.groupBy(*same).agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "line-first", "zstd")
    counts = keep.groupBy("h", "chunk").agg(F.sum("n").alias("n"))
    hot_pieces = hot(counts, ["h", "chunk"], keep.agg(F.sum("n")).first()[0] or 0)
    again = hot_join(pieces, keep.select(*same, "first"), same, hot_pieces, F.col("row"), by=["h", "chunk"])
    gone = again.where("row <> first.row or place <> first.place").groupBy("row").agg(F.collect_list(F.struct("place", "chunk")).alias("gone"))
    gone = stored(gone, "line-gone", "zstd")
    released(pieces, keep)
    schema = "struct<n_lines: long, n_chunks: long, removed_lines: long, removed_chunks: long, kept: string>"
    return rows.join(gone.hint("merge"), "row", "left").select("doc_id", _call(_without, schema, text, F.col("gone")).alias("r")).select("doc_id", "r.*")


#: The same texts by comparing every adjacent pair of lines with all earlier ones, for comparison on small tables of distinct ids.
ORACLE = """
WITH d AS (SELECT doc_id, text, ends_with(text, chr(10)) AS fed, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) END AS l FROM documents),
pairs AS (SELECT doc_id, i, l[i] AS a, l[i + 1] AS b FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM d)),
again AS (SELECT doc_id, i FROM pairs QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest([i, i + 1]) AS i FROM again) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS removed_lines,
  CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(g, i)), lambda i: l[i] || CASE WHEN i < len(l) OR fed THEN chr(10) ELSE '' END), '') END AS kept
FROM d LEFT JOIN gone USING (doc_id)
"""
