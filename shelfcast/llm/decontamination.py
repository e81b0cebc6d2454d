"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of each benchmark item (a shorter item is one window). For the patterns of one
length a table of hashed word pairs tells how far the search may jump; a pair that ends a pattern selects, by the hashes of suffix and
prefix, the few patterns that are compared word by word.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shelfcast.llm.common import bounded_batches, in_struct, released, stored, words_of

WINDOW = 13
#: Words of benchmark text in one broadcast block; more text is searched in further blocks. Measured: see the README.
BLOCK_WORDS = 1_000_000
#: Longer items are cut into pieces of so many words, each of which repeats the last window of the one before but a word.
PIECE_WORDS = 20_000
_RESULT = "struct<n_words: long, spans: array<struct<first: int, after: int>>, items: array<string>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))), ("items", pa.list_(pa.string()))])
_MIX, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


class WuManber:
    """All occurrences of word sequences of one length. Patterns are places in one list of words, tables are arrays: about 30 bytes a word of pattern text."""

    def __init__(self, texts: list[tuple[str, list[bytes]]], length: int):
        """texts: (item, words); every run of `length` words is a pattern of the item."""
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.words = [w for _, words in texts for w in words]
        counts = np.array([len(words) for _, words in texts], np.int64)
        windows = np.maximum(counts - length + 1, 0)
        offsets = np.cumsum(counts) - counts
        starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offsets, windows)
        owner = np.repeat(np.arange(len(texts)), windows)
        h = np.fromiter(map(hash, self.words), np.int64, len(self.words)).view(np.uint64)
        pair = h if self.block == 1 else h[:-1] * np.uint64(_MIX) + h[1:]
        bits = max(12, int(8 * len(pair)).bit_length())
        self.mask = (1 << bits) - 1
        shift = np.full(1 << bits, self.most, np.uint8)
        for end in range(self.block, length + 1):  # later ends have lesser shifts and overwrite
            shift[pair[starts + end - self.block] & np.uint64(self.mask)] = length - end
        self.shift = shift.tobytes()
        suffix, prefix = pair[starts + length - self.block], pair[starts]
        key = (suffix >> np.uint64(32) << np.uint64(32)) | (prefix >> np.uint64(32))
        whole = np.zeros(len(starts), np.uint64)
        for i in range(length):
            whole = whole * np.uint64(_MIX) + h[starts + i]
        order = np.lexsort((whole, key))
        starts, owner, key, whole = starts[order], owner[order], key[order], whole[order]
        new = np.ones(len(starts), bool)
        new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
        for i in np.flatnonzero(~new).tolist():
            new[i] = self.words[starts[i] : starts[i] + length] != self.words[starts[i - 1] : starts[i - 1] + length]
        first = np.flatnonzero(new)
        self.keys, self.at = array("Q", key[first].tobytes()), array("q", starts[first].tobytes())
        self.bounds, self.owner = np.append(first, len(starts)), owner
        self.names = [item for item, _ in texts]

    def items(self, pattern: int) -> set[str]:
        """Items that have a pattern."""
        return {self.names[i] for i in np.unique(self.owner[self.bounds[pattern] : self.bounds[pattern + 1]]).tolist()}

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Start and pattern of each occurrence."""
        length, block, shift, mask, end = self.length, self.block, self.shift, self.mask, self.length
        while end <= len(words):
            pair = hash(words[end - 1]) & _WORD if block == 1 else (hash(words[end - 2]) * _MIX + hash(words[end - 1])) & _WORD
            step = shift[pair & mask]
            if step:
                end += step
                continue
            start = end - length
            prefix = hash(words[start]) & _WORD if block == 1 else (hash(words[start]) * _MIX + hash(words[start + 1])) & _WORD
            key = pair >> 32 << 32 | prefix >> 32
            i = bisect_left(self.keys, key)
            while i < len(self.keys) and self.keys[i] == key:
                if self.words[self.at[i] : self.at[i] + length] == words[start:end]:
                    yield start, i
                i += 1
            end += 1


def searchers(rows: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each length of pattern in (item, text)."""
    by_length: dict[int, list[tuple[str, list[bytes]]]] = {}
    known: dict[bytes, bytes] = {}
    for item, text in rows:
        words = [known.setdefault(w, w) for w in words_of(text)]
        if words:
            by_length.setdefault(min(window, len(words)), []).append((item, words))
    return [WuManber(texts, length) for length, texts in by_length.items()]


def search(words: list[bytes], found_by: list[WuManber]) -> tuple[list[dict], list[str]]:
    """Merged word spans inside occurrences, and the items that occur, in string order."""
    hits, items = [], set()
    for s in found_by:
        patterns = set()
        for start, pattern in s.find(words):
            hits.append((start, start + s.length))
            patterns.add(pattern)
        for pattern in patterns:
            items |= s.items(pattern)
    merged: list[list[int]] = []
    for first, after in sorted(hits):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(after, merged[-1][1])
        else:
            merged.append([first, after])
    return [{"first": a, "after": b} for a, b in merged], sorted(items)


def _pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """item, words (joined by spaces), n of each item, long items in pieces that have all their windows; split into words by Spark's tasks."""

    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            words = words_of(text.as_py())
            starts = range(0, max(1, len(words) - window + 1), most - window + 1) if words else ()
            out.append([{"words": b" ".join(words[i : i + most]), "n": len(words[i : i + most])} for i in starts])
        return pa.array(out, pa.list_(pa.struct([("words", pa.binary()), ("n", pa.int64())])))

    picked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    pieces = picked.select("item", F.explode(arrow_udf(cut, "array<struct<words: binary, n: long>>")(F.col("text"))).alias("p"))
    return pieces.select("item", "p.*").dropDuplicates(["item", "words"])


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of at most block_words words. Pieces are dealt to blocks by hash; only one block at a time comes to the driver."""
    pieces = stored(_pieces(benchmark, window, max(2 * window, min(PIECE_WORDS, block_words // 4))), "benchmark-pieces")
    total, n_pieces = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_blocks = 1 if total <= block_words else -(-2 * total // block_words)
    while True:
        block = F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks))
        largest = pieces.groupBy(block.alias("b")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= block_words or n_blocks > 64 * n_pieces:
            break
        n_blocks *= 2
    for b in range(n_blocks if n_pieces else 0):
        rows = [(r["item"], bytes(r["words"])) for r in pieces.where(block == b).collect()]
        if rows:
            yield rows
    released(pieces)


def _search_column(docs: DataFrame, rows: list[tuple[str, bytes]], window: int) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    ready: list[list[WuManber]] = []

    @arrow_udf(_RESULT)
    def found(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(searchers(shared.value, window))
        out = []
        for text in texts:
            words = words_of(text.as_py())
            where, items = search(words, ready[0])
            out.append({"n_words": len(words), "spans": where, "items": items})
        return pa.array(out, _ARROW)

    return found(F.col("text").cast("binary"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc (a struct of all columns of docs, whatever their names) and hits (n_words, spans (first word, word after) and items found in the whole text) for each row of docs (text, ...).

    Only a block of the benchmark is ever broadcast. With several blocks the documents are written once, with a row number and the first block's hits; every further pass reads
    their texts alone and stores only the rows that it hits, and one join by row number brings all together. So memory doesn't grow with the benchmark, and what is written grows with its hits.
    Null texts and texts without words have no hits; items without words or id are never found.
    """
    bounded_batches(docs.sparkSession)
    blocks = _blocks(benchmark, window, block_words)
    docs = in_struct(docs, "text").withColumn("hits", _search_column(docs, next(blocks, []), window))
    rows, passes = docs, []
    for block in blocks:
        if not passes:
            rows = stored(docs.select("doc", "hits", F.monotonically_increasing_id().alias("row")), "decontamination", "zstd")
        found = rows.select("row", F.col("doc.text").alias("text")).select("row", _search_column(rows, block, window).alias("hits"))
        passes.append(stored(found.where(F.size("hits.items") > 0).select("row", "hits.spans", "hits.items"), "decontamination-hits", "zstd"))
    spans, items = F.col("hits.spans"), F.col("hits.items")
    if passes:
        of_row = [F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("spans", "items")]
        more = stored(reduce(DataFrame.union, passes).groupBy("row").agg(*of_row), "decontamination-rows", "zstd")
        released(*passes)
        rows = rows.join(more, "row", "left")
        spans, items = (F.concat(c, F.coalesce(f"more_{n}", F.array().cast(t))) for c, n, t in ((spans, "spans", "array<struct<first: int, after: int>>"), (items, "items", "array<string>")))
    return rows.select("doc", F.struct(F.col("hits.n_words").alias("n_words"), F.sort_array(spans).alias("spans"), F.sort_array(F.array_distinct(items)).alias("items")).alias("hits"))


def hit_words(spans: Column) -> Column:
    """Words covered by sorted spans, each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("upto"))

    def add(acc: Column, x: Column) -> Column:
        fresh = F.greatest(F.lit(0).cast("long"), x["after"] - F.greatest(x["first"].cast("long"), acc["upto"]))
        return F.struct((acc["covered"] + fresh).alias("covered"), F.greatest(acc["upto"], x["after"].cast("long")).alias("upto"))

    return F.aggregate(spans, start, add, lambda acc: acc["covered"])


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """A twentieth of the words or more stand in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


#: The same answer by an equality join of all windows, for comparison on small tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p0 AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM p0),
lengths AS (SELECT DISTINCT n FROM p),
o0 AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
o AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM o0),
m AS (SELECT r, i, o.n, item FROM o JOIN p ON o.n = p.n AND o.k = p.k),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS at FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
