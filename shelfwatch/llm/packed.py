"""Packed arrays that blocks of documents exchange: cut by a hash's leading bits, joined into one value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def bucket_slices(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Non-empty runs of sorted hashes by their leading bits."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    for a, b in zip(starts, np.append(starts[1:], len(hashes))):
        yield int(bucket[a]), slice(a, b)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as steps of 6 bytes, byte by byte, where they fit, which is nearly always."""
    steps = np.diff(values, prepend=np.uint64(0))
    if len(steps) > 1 and steps[1:].max() < 1 << 48:
        return b"\x06" + values[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
    return b"\x08" + values.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[0] == 8:
        return np.frombuffer(data, "<u8", offset=1)
    steps = np.zeros(((len(data) - 9) // 6 + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(6, -1).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def joined(parts: list[bytes]) -> bytes:
    """Several byte strings as one, with their lengths before them."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def parted(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    at = np.cumsum([4 * n + 4, *np.frombuffer(data, "<u4", n, 4)])
    return [data[a:b] for a, b in zip(at, at[1:])]


def pack_counts(values: np.ndarray) -> bytes:
    """Numbers below 2**32, their lowest bytes first, so that the rest compresses to nothing."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def squeezed(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(joined(parts))


def unsqueezed(data: bytes) -> list[bytes]:
    return parted(zstandard.ZstdDecompressor().decompress(data))
