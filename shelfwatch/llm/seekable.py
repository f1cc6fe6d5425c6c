"""Independent zstandard frames followed by a seek table.

The table is a skippable frame with one entry per data frame (compressed size, size,
checksum: the low 32 bits of the content's XXH64) and a fixed footer, so plain zstd tools
read the file as one stream and a reader with the table decompresses single frames.
"""

from __future__ import annotations

import struct

import numpy as np
import xxhash
import zstandard

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
FOOTER_BYTES = 9
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])


class FrameWriter:
    """Appends frames to a stream; `close` appends the seek table."""

    def __init__(self, out, level: int = 3):
        self._out = out
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._entries: list[tuple[int, int, int]] = []

    @property
    def frames(self) -> int:
        return len(self._entries)

    def add(self, content: bytes) -> int:
        """Writes one frame and returns its number."""
        packed = self._zstd.compress(content)
        self._out.write(packed)
        self._entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return len(self._entries) - 1

    def close(self) -> None:
        table = np.array(self._entries, dtype=ENTRY).tobytes()
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + FOOTER_BYTES))
        self._out.write(table + struct.pack("<IBI", len(self._entries), HAS_CHECKSUMS, FOOTER_MAGIC))


class FrameReader:
    """Reads single frames of a seekable file by number, verifying their checksums."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        source.seek(size - FOOTER_BYTES)
        count, flags, magic = struct.unpack("<IBI", source.read(FOOTER_BYTES))
        if magic != FOOTER_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - FOOTER_BYTES - count * ENTRY.itemsize)
        self.entries = np.frombuffer(source.read(count * ENTRY.itemsize), dtype=ENTRY)
        sizes = self.entries["packed"].astype(np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self._zstd = zstandard.ZstdDecompressor()

    def read(self, frame: int) -> bytes:
        entry = self.entries[frame]
        self._source.seek(int(self.starts[frame]))
        content = self._zstd.decompress(self._source.read(int(entry["packed"])), max_output_size=int(entry["size"]))
        if len(content) != entry["size"] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != entry["checksum"]:
            raise ValueError(f"frame {frame} is damaged")
        return content
