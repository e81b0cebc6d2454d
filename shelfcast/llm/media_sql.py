"""The media form of op4 written out in SQL, byte by byte as hexadecimal text, for comparison on small tables.

A part is a pair of SQL texts: its bytes as hexadecimal digits and its length in bytes.
"""

from __future__ import annotations

import struct

from shelfcast.llm.media import SAMPLE, SAMPLES_PER_CHUNK, SAMPLES_PER_KEYFRAME, TIMESCALE

Part = tuple[str, str]


def _bytes(b: bytes) -> Part:
    return f"'{b.hex()}'", str(len(b))


def _number(value: str, width: int = 4) -> Part:
    return f"printf('%0{2 * width}x', CAST({value} AS BIGINT))", str(width)


def _numbers(count: str, value: str) -> Part:
    """value, an expression in i, for i from 0 up to count."""
    return f"array_to_string(list_transform(range({count}), lambda i: printf('%08x', CAST({value} AS BIGINT))), '')", f"4 * ({count})"


def _box(kind: bytes, *parts: Part) -> Part:
    length = " + ".join(["8", *[n for _, n in parts]])
    return " || ".join([_number(length)[0], _bytes(kind)[0], *[h for h, _ in parts]]), f"({length})"


def _full(kind: bytes, *parts: Part, version: int = 0, flags: int = 0) -> Part:
    return _box(kind, _bytes(struct.pack(">I", version << 24 | flags)), *parts)


def _movie(first: str) -> Part:
    """moov of n samples in c chunks with k sync samples, the payload at byte `first`."""
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", _bytes(struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16)))
    whole, last = f"n >= {SAMPLES_PER_CHUNK}", f"n % {SAMPLES_PER_CHUNK}"
    runs = (
        f"CASE WHEN {whole} THEN '{struct.pack('>3I', 1, SAMPLES_PER_CHUNK, 1).hex()}' ELSE '' END || CASE WHEN {last} > 0 THEN {_number('c')[0]} || {_number(last)[0]} || '00000001' ELSE '' END",
        f"12 * (CAST({whole} AS INT) + CAST({last} > 0 AS INT))",
    )
    table = _box(
        b"stbl", _full(b"stsd", _bytes(struct.pack(">I", 1)), entry), _full(b"stts", _bytes(struct.pack(">I", 1)), _number("n"), _bytes(struct.pack(">I", SAMPLE))),
        _full(b"stsc", _number(f"CAST({whole} AS INT) + CAST({last} > 0 AS INT)"), runs), _full(b"stsz", _bytes(struct.pack(">I", SAMPLE)), _number("n")),
        _full(b"stss", _number("k"), _numbers("k", f"1 + {SAMPLES_PER_KEYFRAME} * i")), _full(b"stco", _number("c"), _numbers("c", f"{first} + {SAMPLE * SAMPLES_PER_CHUNK} * i")),
    )
    ticks = _number(f"{SAMPLE} * n", 8)
    data = _box(b"dinf", _full(b"dref", _bytes(struct.pack(">I", 1)), _full(b"url ", flags=1)))
    media = _box(
        b"mdia", _full(b"mdhd", _bytes(struct.pack(">QQI", 0, 0, TIMESCALE)), ticks, _bytes(struct.pack(">HH", 0x55C4, 0)), version=1),
        _full(b"hdlr", _bytes(struct.pack(">I4s12x", 0, b"soun") + b"payload\0")), _box(b"minf", _full(b"smhd", _bytes(bytes(4))), data, table),
    )
    head = _full(b"tkhd", _bytes(struct.pack(">QQII", 0, 0, 1, 0)), ticks, _bytes(struct.pack(">8xhhHH", 0, 0, 256, 0) + matrix + bytes(8)), version=1, flags=3)
    top = _full(b"mvhd", _bytes(struct.pack(">QQI", 0, 0, TIMESCALE)), ticks, _bytes(struct.pack(">IH10x", 0x10000, 256) + matrix + bytes(24) + struct.pack(">I", 2)), version=1)
    return _box(b"moov", top, _box(b"trak", head, media))


_HEAD = _box(b"ftyp", _bytes(b"isom" + struct.pack(">I", 512) + b"isomiso2mp41"))
#: Valid for payloads of less than 4 GB.
ORACLE = f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
payloads AS (SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, h || repeat('00', CAST(CASE WHEN h = '' THEN {SAMPLE} ELSE (-(len(h) // 2) % {SAMPLE} + {SAMPLE}) % {SAMPLE} END AS BIGINT)) AS p FROM texts),
counts AS (SELECT *, len(p) // {2 * SAMPLE} AS n, (len(p) // {2 * SAMPLE} + {SAMPLES_PER_CHUNK - 1}) // {SAMPLES_PER_CHUNK} AS c, (len(p) // {2 * SAMPLE} + {SAMPLES_PER_KEYFRAME - 1}) // {SAMPLES_PER_KEYFRAME} AS k FROM payloads),
places AS (SELECT *, {_HEAD[1]} + {_movie("0")[1]} + 8 AS body FROM counts),
files AS (SELECT *, {_HEAD[0]} || {_movie("body")[0]} || {_number(f"8 + {SAMPLE} * n")[0]} || '{b"mdat".hex()}' || p AS m, right(p, {2 * SAMPLE}) AS tail FROM places)
SELECT doc_id, n_bytes, CAST({SAMPLE} * n AS BIGINT) AS payload_bytes, sha256(unhex(p)) AS payload_sha256,
  CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range({SAMPLE}), lambda i: CAST('0x' || substr(tail, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS BIGINT) AS tail_crc32,
  CAST(len(m) // 2 AS BIGINT) AS media_bytes, sha256(unhex(m)) AS media_sha256, concat('codec=raw;duration=', {SAMPLE} * n, '/{TIMESCALE};samples=', n, ';keyframes=', k) AS feature,
  array_to_string(list_transform(range(k), lambda i: concat(body + {SAMPLE * SAMPLES_PER_KEYFRAME} * i, ':', body + {SAMPLE * SAMPLES_PER_KEYFRAME} * i + {SAMPLE})), ',') AS keyframes
FROM files, crc
"""
