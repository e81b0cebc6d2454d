"""Media columns: ISO base media files written from payloads and read back by walking their boxes.

`write_movie` stores bytes as one track of 8-bit PCM samples in chunks. `read_movie` walks nested boxes, decodes the sample tables and
gives codec, duration and the byte range of every sync sample and chunk; it reads box headers and tables only, never the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

SAMPLE = 64
SAMPLES_PER_CHUNK = 16
SAMPLES_PER_KEYFRAME = 32
TIMESCALE = 8000
#: Four-character codes of boxes that hold boxes. Fixed values of the container format.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"moof", b"traf", b"mvex", b"udta")
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_movie(payload: bytes) -> bytes:
    """A movie of one track whose samples are SAMPLE bytes each; the payload's length is a multiple of SAMPLE."""
    n = len(payload) // SAMPLE
    chunks = -(-n // SAMPLES_PER_CHUNK)
    ticks = n * SAMPLE
    wide = len(payload) >= (1 << 32) - 65536
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def movie(first: int) -> bytes:
        where = first + np.arange(chunks, dtype=np.int64) * SAMPLE * SAMPLES_PER_CHUNK
        runs = [(1, SAMPLES_PER_CHUNK)] if n >= SAMPLES_PER_CHUNK else []
        if n % SAMPLES_PER_CHUNK:
            runs.append((chunks, n % SAMPLES_PER_CHUNK))
        entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", at, many, 1) for at, many in runs]),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"stss", struct.pack(">I", -(-n // SAMPLES_PER_KEYFRAME)), np.arange(1, n + 1, SAMPLES_PER_KEYFRAME, dtype=">u4").tobytes()),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), where.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"payload\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">QQIIQ8xhhHH", 0, 0, 1, 0, ticks, 0, 0, 256, 0), _MATRIX, struct.pack(">II", 0, 0), version=1, flags=3)
        top = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 256), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", top, _box(b"trak", track, media))

    data_header = 16 if len(payload) + 8 >= 1 << 32 else 8
    first = len(head) + len(movie(0)) + data_header
    return head + movie(first) + _box(b"mdat", payload)


def walk(data: bytes | memoryview):
    """(kind, start of body, end) of every box, outer ones before inner ones, in file order. A size of 0 reaches to the end, 1 means a 64-bit size; a broken box ends its level.

    Open levels are kept on a list, so nesting as deep as the file is long is walked like any other.
    """
    start, ends = 0, [len(data)]
    while ends:
        end = ends[-1]
        size, header = 0, 8
        if start + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, start)
            if size == 1 and start + 16 <= end:
                size, header = struct.unpack_from(">Q", data, start + 8)[0], 16
            elif size == 0:
                size = end - start
        if size < header or start + size > end:
            start = ends.pop()
            continue
        yield kind, start + header, start + size
        if kind in CONTAINERS:
            ends.append(start + size)
            start += header
        else:
            start += size


class BrokenTrack(ValueError):
    """A track whose boxes or sample tables contradict each other or reach beyond their boxes."""


@dataclass
class Track:
    """What the sample tables of one track say; ranges are (first byte, byte after) in the file."""

    codec: str
    timescale: int
    duration: int
    n_samples: int
    chunk_ranges: np.ndarray
    keyframe_ranges: np.ndarray


Boxes = dict[bytes, tuple[int, int]]


def _field(data: bytes, boxes: Boxes, kind: bytes, form: str, skip: int) -> tuple:
    at, end = boxes[kind]
    if at + skip + struct.calcsize(form) > end:
        raise BrokenTrack(kind)
    return struct.unpack_from(form, data, at + skip)


def _table(data: bytes, boxes: Boxes, kind: bytes, form: str, width: int = 1, skip: int = 4) -> np.ndarray:
    """The entries of a counted table, none of them beyond the end of its box."""
    (count,) = _field(data, boxes, kind, ">I", skip)
    at, end = boxes[kind]
    if at + skip + 4 + count * width * np.dtype(form).itemsize > end:
        raise BrokenTrack(kind)
    values = np.frombuffer(data, form, count * width, at + skip + 4)
    if count and values.max() >= 1 << 62:
        raise BrokenTrack(kind)
    return values.astype(np.int64).reshape(-1, width)


def _track(data: bytes, boxes: Boxes) -> Track:
    """A track from its boxes. Samples are only expanded where the file has a size for each, so memory follows the file's length."""
    if not {b"mdhd", b"stsd", b"stsc", b"stsz"} <= boxes.keys() or not {b"stco", b"co64"} & boxes.keys():
        raise BrokenTrack("tables are missing")
    long = _field(data, boxes, b"mdhd", ">B", 0)[0] == 1
    timescale, duration = _field(data, boxes, b"mdhd", ">IQ" if long else ">II", 20 if long else 12)
    codec = _field(data, boxes, b"stsd", ">4s", 12)[0].decode("latin-1")
    same, n = _field(data, boxes, b"stsz", ">II", 4)
    sizes = None if same else _table(data, boxes, b"stsz", ">u4", skip=8)[:, 0]
    chunks = _table(data, boxes, b"stco", ">u4")[:, 0] if b"stco" in boxes else _table(data, boxes, b"co64", ">u8")[:, 0]
    runs = _table(data, boxes, b"stsc", ">u4", 3)
    lengths = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if len(chunks) and (not len(runs) or runs[0, 0] != 1 or (lengths < 1).any()) or not len(chunks) and len(runs):
        raise BrokenTrack(b"stsc")
    per_chunk = np.repeat(runs[:, 1], lengths)
    until = np.cumsum(per_chunk)
    if (until[-1] if len(until) else 0) != n:
        raise BrokenTrack("chunks and sizes differ in samples")
    first = until - per_chunk
    total = np.concatenate([[0], np.cumsum(sizes)]) if sizes is not None else None

    def upto(sample: np.ndarray) -> np.ndarray:
        """Bytes of all samples before each of these."""
        return sample * same if total is None else total[sample]

    ranges = np.stack([chunks, chunks + upto(until) - upto(first)], 1)
    if b"stss" not in boxes:
        return Track(codec, timescale, duration, n, ranges, ranges)
    keys = _table(data, boxes, b"stss", ">u4")[:, 0] - 1
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise BrokenTrack(b"stss")
    of = np.searchsorted(until, keys, "right")
    starts = chunks[of] + upto(keys) - upto(first[of])
    return Track(codec, timescale, duration, n, ranges, np.stack([starts, starts + upto(keys + 1) - upto(keys)], 1))


def read_movie(data: bytes) -> list[Track]:
    """The tracks of a movie, from its boxes and sample tables alone. A broken track is left out. Without a table of sync samples all are such, and its keyframe ranges are its chunks."""
    tracks: list[Boxes] = []
    inside = 0
    for kind, at, end in walk(data):
        if kind == b"trak":
            tracks.append({})
            inside = end
        elif tracks and at <= inside:
            tracks[-1].setdefault(kind, (at, end))
    out = []
    for boxes in tracks:
        try:
            out.append(_track(data, boxes))
        except BrokenTrack:
            continue
    return out


def payload_of(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, gathered chunk by chunk."""
    return b"".join(data[a:b] for a, b in track.chunk_ranges.tolist())


def padded(text: bytes | None) -> bytes:
    """The bytes with zeros up to a positive multiple of SAMPLE."""
    text = text or b""
    return text + bytes(-len(text) % SAMPLE if text else SAMPLE)


_RESULT = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("keyframes", pa.string())])


def _described(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts:
        text = text.as_py()
        media = write_movie(padded(text))
        (track,) = read_movie(media)
        payload = payload_of(media, track)
        keys = track.keyframe_ranges
        ranges = ",".join(f"{a}:{b}" for a, b in keys.tolist())
        feature = f"codec={track.codec.strip()};duration={track.duration}/{track.timescale};samples={track.n_samples};keyframes={len(keys)}"
        out.append({"n_bytes": len(text or b""), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-SAMPLE:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "keyframes": ranges})
    return pa.array(out, _RESULT)


def _written(payloads: pa.Array) -> pa.Array:
    return pa.array([write_movie(padded(p.as_py())) for p in payloads], pa.binary())


_TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))]))


def _read(media: pa.Array) -> pa.Array:
    out = []
    for m in media:
        tracks = read_movie(m.as_py() or b"")
        out.append([{"codec": t.codec, "seconds": t.duration / t.timescale if t.timescale else None, "n_samples": t.n_samples, "keyframes": [{"first": a, "after": b} for a, b in t.keyframe_ranges.tolist()]} for t in tracks])
    return pa.array(out, _TRACKS)


def write_media(payload: Column) -> Column:
    """A movie holding the bytes or text of `payload`, padded with zeros; null and empty give a movie of one zero sample."""
    return arrow_udf(_written, "binary")(payload.cast("binary"))


def read_media(media: Column) -> Column:
    """Codec, seconds, number of samples and keyframe byte ranges of each track; null, empty and broken files have no tracks."""
    return arrow_udf(_read, "array<struct<codec: string, seconds: double, n_samples: long, keyframes: array<struct<first: long, after: long>>>>")(media)


def describe_media(payload: Column) -> Column:
    """Stores `payload` as a movie, reads it back by its sample tables, and gives checksums of both forms, a feature string, and the byte range (first:after) of each keyframe; equal payloads give equal values."""
    schema = "struct<n_bytes: long, payload_bytes: long, payload_sha256: string, tail_crc32: long, media_bytes: long, media_sha256: string, feature: string, keyframes: string>"
    return arrow_udf(_described, schema)(payload.cast("binary"))
