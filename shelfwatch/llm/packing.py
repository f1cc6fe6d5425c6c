"""Packing of documents into fixed-length training sequences.

First-fit decreasing inside random groups of documents: a group is small enough for one
task and large enough that its last, half-filled sequence hardly counts.  The first bin
with room is found in a tournament tree over the bins' free lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

GROUP_DOCS = 2048
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, _group long"
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, groups: int, seed: int = 10) -> DataFrame:
    """Pieces of at most `capacity` ids of every row's `text` with its end id, and the row's random group.

    A null text is empty (the end id alone).  `ids` are little-endian unsigned 32-bit integers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = end_id.to_bytes(encode.width, "little")
        for batch in batches:
            rows = []
            for doc, text, group in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(encode.encode(text) + end, dtype=f"<u{encode.width}").astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    rows.append((doc, at, len(piece), len(ids), piece.tobytes(), group))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
            names = ["doc_id", "start", "length", "doc_tokens", "ids", "_group"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names
            )
        encode.release()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups)).alias("_group"),
    )
    return rows.mapInArrow(cut, PIECES)


class Tournament:
    """Bins of equal capacity; finds the first one with enough room in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self._leaves = 1 << max(0, (bins - 1).bit_length())
        self._free = [capacity] * (2 * self._leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Puts `length` into the first bin with room; returns the bin and the room it had."""
        free, node = self._free, 1
        while node < self._leaves:
            node = 2 * node if free[2 * node] >= length else 2 * node + 1
        room = free[node]
        bin_ = node - self._leaves
        free[node] = room - length
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return bin_, room


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; longer ones are placed first, equal ones in the given order."""
    bins = Tournament(max(1, len(lengths)), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_, room = bins.place(lengths[i])
        out[i] = (bin_, capacity - room)
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packs all rows into sequences of at most `capacity` ids; one output row per piece of a document.

    Rows are dealt by a hash to groups of about `group_docs`.  A row longer than a sequence is
    cut from its start into whole sequences and a rest.  Repeated rows are packed as often as
    they occur, null ids and texts included; an empty table gives no rows; other columns are
    not read.  `ids` are the piece's ids, so a sequence is its pieces ordered by `offset`.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def fit(rows: pa.Table) -> pa.Table:
        keys = [("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")]
        rows = rows.sort_by(keys)
        places = first_fit_decreasing(rows["length"].to_pylist(), capacity)
        base = rows["_group"][0].as_py() << 32
        rows = rows.drop_columns(["_group"])
        rows = rows.append_column("sequence_id", pa.array([base + b for b, _ in places], type=pa.int64()))
        return rows.append_column("offset", pa.array([o for _, o in places], type=pa.int64()))

    pieces = tokenize(docs, vocabulary, end_id, capacity, groups)
    return pieces.groupBy("_group").applyInArrow(fit, PACKED)
