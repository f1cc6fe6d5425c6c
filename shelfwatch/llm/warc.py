"""Web archives in seekable zstandard bundles.

Every task writes one archive: records grouped into independent frames, then a seek table.
The index maps a record's identifier to its frame and the offset inside the frame, so one
record is read by decompressing one frame.  Payloads that occur more than once are stored
once; the other pages get revisit records that refer to the first.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import spread_join
from ..session import cut_lineage
from .files import by_file, new_file, open_random
from .seekable import FrameReader, FrameWriter

FRAME_BYTES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# Fixed value of the archive format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, path string, frame int, offset int, length int"
READ = (
    "page_id long, record_id string, url string, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One archive record; a page that refers to another is a revisit and keeps no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; a response's payload is held against its digest."""
    lines, block = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    refers_to = fields.get("WARC-Refers-To-Page-ID")
    return {
        "record_id": fields["WARC-Record-ID"],
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_digest": named,
        "payload_bytes": size,
        "refers_to": None if refers_to is None else int(refers_to),
        "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes a record per row of `page_id, url, html` below `folder`; returns the index.

    Of rows with equal payloads of at least `least_bytes` bytes the one with the smallest
    `page_id` is a response and the others revisit it; rows that share that smallest id are
    all responses.  A null html is an empty payload, a null `page_id` is a response only where
    no row with its payload has an id, and a null url is left out.  An empty table gives no
    archive.  Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        with new_file(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.zst") as (path, out):
            frames, held = FrameWriter(out), bytearray()
            while batch is not None:
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = record(page_id, url, html, refers_to)
                    if held and len(held) + len(data) > frame_bytes:
                        frames.add(bytes(held))
                        held.clear()
                    rows.append((page_id, record_id(page_id), path, frames.frames, len(held), len(data)))
                    held += data
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                columns = [pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "record_id", "path", "frame", "offset", "length"])
                batch = next(batches, None)
            frames.add(bytes(held))
            frames.close()

    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("_sha", F.when(F.length("html") >= least_bytes, F.unhex(F.sha1("html"))))
    firsts = rows.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    firsts = firsts.filter("_sha is not null and _n > 1").drop("_n")
    known = spread_join(rows, firsts, ["_sha"], "left", ["page_id"])
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return cut_lineage(known.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(write, INDEX))


def read_archives(index: DataFrame) -> DataFrame:
    """The records of the index's rows; any subset can be asked for."""

    def read(rows: pa.Table) -> pa.Table:
        out, held, content = [], -1, b""
        rows = rows.sort_by([("frame", "ascending"), ("offset", "ascending")])
        with open_random(rows["path"][0].as_py()) as source:
            frames = FrameReader(source)
            for r in rows.to_pylist():
                if r["frame"] != held:
                    held, content = r["frame"], frames.read(r["frame"])
                found = parse(content[r["offset"] : r["offset"] + r["length"]])
                if found["record_id"] != r["record_id"]:
                    raise ValueError(f"the index points at {found['record_id']} for {r['record_id']}")
                out.append({"page_id": r["page_id"], **found})
        names = ["page_id", "record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.binary()]
        return pa.Table.from_pylist(out, schema=pa.schema(list(zip(names, kinds, strict=True))))

    return by_file(index).applyInArrow(read, READ)
