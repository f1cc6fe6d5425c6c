"""Media columns: ISO base media containers built, walked and indexed without decoding a sample.

`to_media` stores bytes as 8-bit mono samples of a raw audio track; `read_media` walks the
nested boxes of any such container, decodes the sample tables and returns codec, duration,
keyframe byte ranges, and the payload that the tables point at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the container format.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf"}
UNIT = 192
RATE = 8000
SAMPLES_PER_CHUNK = 64
SYNC_EVERY = 16
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

KEYFRAMES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
INDEX = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("samples", T.LongType()),
    T.StructField("keyframes", KEYFRAMES),
    T.StructField("payload", T.BinaryType()),
])


def box(kind: bytes, *parts: bytes) -> bytes:
    content = b"".join(parts)
    return struct.pack(">I4s", len(content) + 8, kind) + content


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(content: bytes, unit: int = UNIT) -> bytes:
    """Spaces up to a positive multiple of `unit`."""
    return content.ljust(max(1, -(-len(content) // unit)) * unit, b" ")


def build(payload: bytes, unit: int = UNIT) -> bytes:
    """A container whose samples are the payload's consecutive units."""
    n = len(payload) // unit
    chunks, last = -(-n // SAMPLES_PER_CHUNK), (n - 1) % SAMPLES_PER_CHUNK + 1
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if chunks > 1 or last == SAMPLES_PER_CHUNK else []
    if last < SAMPLES_PER_CHUNK:
        runs.append((chunks, last, 1))
    duration, sync = n * unit, range(1, n + 1, SYNC_EVERY)
    wide = len(payload) > 0xF0000000
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))

    def movie(data_at: int) -> bytes:
        offsets = [data_at + c * SAMPLES_PER_CHUNK * unit for c in range(chunks)]
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, unit)),
            full_box(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", unit, n)),
            full_box(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        source = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1),
            full_box(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full_box(b"smhd", bytes(4)), source, table),
        )
        header = struct.pack(">QQII", 0, 0, 1, 0) + struct.pack(">Q8xHHHH", duration, 0, 0, 0x100, 0) + MATRIX + bytes(8)
        track = box(b"trak", full_box(b"tkhd", header, version=1, flags=7), media)
        general = struct.pack(">QQIQIH10x", 0, 0, RATE, duration, 0x10000, 0x100) + MATRIX + bytes(24) + struct.pack(">I", 2)
        return box(b"moov", full_box(b"mvhd", general, version=1), track)

    front = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    at = len(front) + len(movie(0)) + len(head)
    return b"".join((front, movie(at), head, payload))


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the contents of the boxes between two positions."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit")
        yield kind, at + head, at + size
        at += size


def walk(data: memoryview, at: int, end: int, track: dict, tracks: list[dict]) -> None:
    """Collects the leaf boxes of every track."""
    for kind, start, stop in boxes(data, at, end):
        if kind in CONTAINERS:
            inner = track
            if kind == b"trak":
                inner = {}
                tracks.append(inner)
            walk(data, start, stop, inner, tracks)
        else:
            track[kind] = (start, stop)


def sample_table(data: memoryview, track: dict) -> tuple[np.ndarray, np.ndarray]:
    """(offset, size) of every sample of a track."""
    at = track[b"stsz"][0] + 4
    fixed, n = struct.unpack_from(">II", data, at)
    sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at + 8).astype(np.int64)
    wide = b"co64" in track
    at = track[b"co64" if wide else b"stco"][0] + 4
    chunks = np.frombuffer(data, ">u8" if wide else ">u4", struct.unpack_from(">I", data, at)[0], at + 4).astype(np.int64)
    at = track[b"stsc"][0] + 4
    runs = np.frombuffer(data, ">u4", 3 * struct.unpack_from(">I", data, at)[0], at + 4).reshape(-1, 3).astype(np.int64)
    lengths = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    chunk_of = np.repeat(np.arange(len(chunks)), np.repeat(runs[:, 1], lengths))[:n]
    before = np.cumsum(sizes) - sizes
    opens = np.flatnonzero(np.diff(chunk_of, prepend=-1))
    inside = before - np.repeat(before[opens], np.diff(np.append(opens, n)))
    return chunks[chunk_of] + inside, sizes


def describe(media: bytes) -> dict:
    """Index row of one container: its first track's codec, duration, keyframes and payload."""
    data, tracks = memoryview(media), []
    walk(data, 0, len(data), {}, tracks)
    track = tracks[0]
    at = track[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    offsets, sizes = sample_table(data, track)
    sync = np.arange(len(sizes))
    if b"stss" in track:
        at = track[b"stss"][0] + 4
        sync = np.frombuffer(data, ">u4", struct.unpack_from(">I", data, at)[0], at + 4).astype(np.int64) - 1
    joins = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    opens, stops = np.append(0, joins), np.append(joins, len(sizes))
    parts = [data[offsets[a] : offsets[b - 1] + sizes[b - 1]] for a, b in zip(opens, stops, strict=True) if b > a]
    return {
        "codec": bytes(data[track[b"stsd"][0] + 12 : track[b"stsd"][0] + 16]).decode("latin-1").strip(),
        "timescale": timescale,
        "duration": duration,
        "samples": len(sizes),
        "keyframes": [{"start": int(offsets[i]), "length": int(sizes[i])} for i in sync],
        "payload": b"".join(parts),
    }


def with_media(df: DataFrame, column: str, out: str = "media", unit: int = UNIT) -> DataFrame:
    """Adds a container column holding `column`'s bytes, padded with spaces to whole samples.

    Text is stored as UTF-8.  Null and empty content become one sample of spaces; no limit of
    length below the format's 64-bit sizes.  All other columns stay, one row per row.
    """

    def make(content: pa.Array) -> pa.Array:
        return pa.array([build(pad(c or b"", unit), unit) for c in content.to_pylist()], type=pa.binary())

    return _add(df, F.col(f"`{column}`").cast("binary"), out, T.BinaryType(), make)


def with_index(df: DataFrame, media: str = "media", out: str = "track") -> DataFrame:
    """Adds a struct column with the codec, timescale, duration, sample count, keyframe ranges and payload.

    A null container has a null index; a container that is damaged fails the query.
    """

    def read(containers: pa.Array) -> pa.Array:
        rows = [None if c is None else describe(c) for c in containers.to_pylist()]
        frames = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        kind = [("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64())]
        return pa.array(rows, type=pa.struct([*kind, ("keyframes", frames), ("payload", pa.binary())]))

    return _add(df, F.col(f"`{media}`"), out, INDEX, read)


def _add(df: DataFrame, content, out: str, kind: T.DataType, fn) -> DataFrame:
    @F.arrow_udf(returnType=kind)
    def column(content: pa.Array) -> pa.Array:
        return fn(content)

    return df.withColumn(out, column(content))


def feature(track: str = "track"):
    """One line of text about a track: equal for equal containers."""
    t = F.col(track)
    frames = F.transform(t["keyframes"], lambda k: F.concat_ws("+", k["start"], k["length"]))
    ranges = F.concat_ws(",", frames)
    return F.concat_ws(
        " ", t["codec"], t["timescale"], t["duration"], t["samples"], F.size(t["keyframes"]), F.hex(F.crc32(ranges))
    )
