"""Token ids of documents in binary files of independent zstandard frames.

The documents are range-sorted by id; every task encodes its range and writes one file:
frames of a fixed number of ids, then a seek table with a checksum per frame.  The index
says where a document's ids start, in its file and over all files, so a reader decompresses only the frames
that hold the documents it wants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .files import by_file, new_file, open_random
from .seekable import FrameReader, FrameWriter
from .tokens import encoder

FRAME_IDS = 65536
WRITTEN = "doc_id long, part int, path string, width int, first long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids binary"


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, frame_ids: int = FRAME_IDS
) -> DataFrame:
    """Writes the ids of every row's `text` below `folder`, in ascending `doc_id` order; returns the index.

    One index row per input row: its file and range of ids.  A null text is empty and has
    the end id alone; a null `doc_id` comes first; rows with equal ids follow each other in
    the order of their texts' hash, and repeated rows are written as often as they occur.
    An empty table gives an empty index and no file.  Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = end_id.to_bytes(encode.width, "little")
        part, written, waiting = TaskContext.get().partitionId(), 0, bytearray()
        size = frame_ids * encode.width
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        with new_file(folder, f"part-{part:06d}", ".zst") as (path, out):
            frames = FrameWriter(out)
            while batch is not None:
                first, counts = [], []
                for text in batch.column(1):
                    ids = encode.encode(text.as_py()) + end
                    first.append(written)
                    counts.append(len(ids) // encode.width)
                    written += counts[-1]
                    waiting += ids
                    while len(waiting) >= size:
                        frames.add(bytes(waiting[:size]))
                        del waiting[:size]
                n = batch.num_rows
                columns = [batch.column(0), [part] * n, [path] * n, [encode.width] * n, first, counts]
                yield pa.RecordBatch.from_arrays([
                    c if isinstance(c, pa.Array) else pa.array(c, type=t)
                    for c, t in zip(columns, (None, pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)
                ], ["doc_id", "part", "path", "width", "first", "n_tokens"])
                batch = next(batches, None)
            if waiting:
                frames.add(bytes(waiting))
            frames.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ranges = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    index = cut_lineage(ranges.mapInArrow(write, WRITTEN))
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(files, "part").withColumn("start", F.col("_before") + F.col("first")).drop("_before")


def read_token_files(index: DataFrame) -> DataFrame:
    """The ids of the index's rows, as little-endian unsigned 32-bit integers.

    Any subset of the index's rows can be asked for: only the frames that hold them are read.
    """

    def read(rows: pa.Table) -> pa.Table:
        first, counts = rows["first"].to_numpy(), rows["n_tokens"].to_numpy()
        width = rows["width"][0].as_py()
        order, ids = np.argsort(first, kind="stable"), [b""] * len(rows)
        with open_random(rows["path"][0].as_py()) as source:
            frames = FrameReader(source)
            ends = np.cumsum(frames.entries["size"].astype(np.int64)) // width
            held, content = -1, b""
            for i in order:
                at, end, parts = int(first[i]), int(first[i] + counts[i]), []
                while at < end:
                    frame = int(np.searchsorted(ends, at, side="right"))
                    if frame != held:
                        held, content = frame, frames.read(frame)
                    base = int(ends[frame]) - len(content) // width
                    stop = min(end, int(ends[frame]))
                    parts.append(content[(at - base) * width : (stop - base) * width])
                    at = stop
                ids[i] = np.frombuffer(b"".join(parts), dtype=f"<u{width}").astype("<u4").tobytes()
        return rows.select(["doc_id", "start", "n_tokens"]).append_column("ids", pa.array(ids, type=pa.binary()))

    return by_file(index).applyInArrow(read, READ)

