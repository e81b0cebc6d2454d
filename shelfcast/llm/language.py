"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the elementwise product (binding) of its letters' vectors, permuted by
their place; a document is the sum (bundle) of its trigrams; a language's prototype is the bundle of its documents. A document goes to
the prototype of greatest cosine, after the mean of all prototypes, which holds what languages share, was taken off both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shelfcast.llm.common import bounded_batches

DIMENSIONS = 512
SEED = 20240229
UNKNOWN = "und"
#: Letters other than a-z share so many classes by code point.
SYMBOLS = 128
#: Characters and pieces of texts handled at once.
PIECE, ROWS = 1 << 18, 256
_cache: dict[str, np.ndarray] = {}


def _symbols() -> np.ndarray:
    """Class of each code point: 0 for what is no letter, 1-26 for a-z, 27 and up for the others."""
    if "symbols" not in _cache:
        out = np.fromiter((str.isalpha(chr(c)) for c in range(0x110000)), bool, 0x110000)
        other = 27 + np.arange(0x110000) % (SYMBOLS - 27)
        classes = np.where(out, other, 0).astype(np.uint8)
        classes[97:123] = np.arange(1, 27)
        _cache["symbols"] = classes
    return _cache["symbols"]


def _letters() -> np.ndarray:
    """Letter vectors for each of the three places: place p holds the base vectors rotated by p."""
    if "letters" not in _cache:
        base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
        _cache["letters"] = np.stack([np.roll(base, 2 - p, axis=1) for p in range(3)])
    return _cache["letters"]


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes (27 bits of three symbols)."""
    place = _letters()
    return (place[0][codes // SYMBOLS**2] * place[1][codes // SYMBOLS % SYMBOLS] * place[2][codes % SYMBOLS]).astype(np.float32)


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text and its number of letters. Runs of other characters count as one border; texts begin and end with one.

    A long text is handled in pieces; each carries over the last two symbols of the one before, so its trigrams are those of the whole.
    """
    vectors, letters = np.zeros((len(texts), DIMENSIONS)), np.zeros(len(texts), np.int64)
    pending, n = [], 0
    for i, text in enumerate(texts):
        low, carried = f" {text.lower()} ", np.zeros(0, np.uint8)
        for at in range(0, len(low), PIECE):
            symbols = _symbols()[np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "replace"), np.uint32)]
            letters[i] += np.count_nonzero(symbols)
            symbols = np.concatenate([carried, symbols])
            keep = np.ones(len(symbols), bool)
            keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
            symbols = symbols[keep]
            pending.append((i, symbols))
            carried, n = symbols[-2:], n + len(symbols)
            if n >= PIECE or len(pending) == ROWS:
                _add(pending, vectors)
                pending, n = [], 0
    _add(pending, vectors)
    return vectors, letters


def _add(pieces: list[tuple[int, np.ndarray]], vectors: np.ndarray) -> None:
    """Adds the bound trigrams of each piece to its text's vector. Trigrams of different pieces are never mixed."""
    if not pieces:
        return
    symbols = np.concatenate([s for _, s in pieces]).astype(np.int64)
    rows = np.repeat(np.arange(len(pieces)), [len(s) for _, s in pieces])
    codes = symbols[:-2] * SYMBOLS**2 + symbols[1:-1] * SYMBOLS + symbols[2:]
    inside = (rows[:-2] == rows[2:]) & (codes != 0)
    codes, at = codes[inside], rows[:-2][inside]
    seen = np.flatnonzero(np.bincount(codes, minlength=1))
    place = np.zeros(seen[-1] + 1 if len(seen) else 0, np.int64)
    place[seen] = np.arange(len(seen))
    counts = np.bincount(at * len(seen) + place[codes], minlength=len(pieces) * len(seen)).reshape(len(pieces), len(seen))
    np.add.at(vectors, [i for i, _ in pieces], counts.astype(np.float32) @ trigram_vectors(seen))


@dataclass
class Profiles:
    """Language names and their prototypes, one row each, of length 1; `common` is what was taken off them."""

    names: list[str]
    prototypes: np.ndarray
    common: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1: the cosine moved into that range) of each text; no letters, or no languages, give UNKNOWN and 0."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        vectors, letters = bundles([t or "" for t in texts])
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = vectors / np.maximum(length, 1e-9) - self.common
        cosine = vectors @ self.prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        best = cosine.argmax(1)
        known = letters > 0
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, (1 + cosine.max(1)) / 2, 0.0).clip(0, 1)


def learn(docs: DataFrame) -> Profiles:
    """Profiles from every row of docs (text, lang) that has both. Each task sends one vector a language, so the driver gets languages x DIMENSIONS numbers whatever the number of rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            vectors, _ = bundles(batch.column(0).to_pylist())
            for lang in set(langs):
                mine = vectors[[x == lang for x in langs]].sum(0, dtype=np.float64)
                total[lang] = total.get(lang, 0) + mine
        for lang, v in sorted(total.items()):
            yield pa.RecordBatch.from_pydict({"lang": [lang] * DIMENSIONS, "place": list(range(DIMENSIONS)), "value": v.astype(np.int64)}, pa.schema([("lang", pa.string()), ("place", pa.int32()), ("value", pa.int64())]))

    rows = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string"))
    parts = rows.mapInArrow(summed, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    got = parts.toPandas()
    if got.empty:
        return Profiles([], np.zeros((0, DIMENSIONS)), np.zeros(DIMENSIONS))
    wide = got.pivot(index="lang", columns="place", values="value").sort_index().to_numpy(float)
    wide /= np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-9)
    common = wide.mean(0) if len(wide) > 1 else np.zeros(DIMENSIONS)
    wide -= common
    wide /= np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-9)
    return Profiles(sorted(got["lang"].unique()), wide.astype(np.float32), common.astype(np.float32))


def predict_language(docs: DataFrame, profiles: Profiles, text: str = "text") -> Column:
    """struct<lang, score> for a text column. The profiles (languages x DIMENSIONS numbers) are broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return arrow_udf(predicted, "struct<lang: string, score: double>")(F.col(text))
