"""Token files, archives, media columns and packing: exact round trips."""

import base64
import hashlib
import io

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from shelfwatch.llm import media, packing, token_files, warc
from shelfwatch.llm.seekable import FrameReader, FrameWriter
from shelfwatch.llm.tokens import Encoder
from shelfwatch.session import shared_path

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def ids_of(vocabulary, text):
    return Tokenizer.from_file(vocabulary).encode(text or "", add_special_tokens=False).ids + [2]


def test_seekable_frames():
    out, parts = io.BytesIO(), [b"", b"a" * 100000, bytes(range(256)) * 7]
    writer = FrameWriter(out)
    assert [writer.add(p) for p in parts] == [0, 1, 2]
    writer.close()
    reader = FrameReader(Source(out.getvalue()))
    assert [reader.read(i) for i in (2, 0, 1)] == [parts[2], parts[0], parts[1]]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True)
    assert plain.read() == b"".join(parts)
    damaged = bytearray(out.getvalue())
    damaged[int(reader.starts[2]) + 14] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        FrameReader(Source(bytes(damaged))).read(2)


@pytest.mark.parametrize("vocabulary", [BYTES, WORDS])
def test_encoder_equals_library(vocabulary, docs):
    texts = [r[0] or "" for r in docs.select("text").collect()]
    texts += ["it's  we'll\n\n x", "½ ² á ­ ſ İ", "tab\x0b\x0c\rz\x1cq", "“a” — €5…", "a  b\t\tc \n ", "Ωmega ж"]
    encoder = Encoder(vocabulary)
    for text in texts:
        assert np.frombuffer(encoder.encode(text), f"<u{encoder.width}").tolist() == ids_of(vocabulary, text)[:-1]


def test_token_files(spark, docs, no_docs):
    index = token_files.write_token_files(docs, shared_path(spark, "t"), BYTES, 2, frame_ids=1000)
    rows = token_files.read_token_files(index).collect()
    expected = [(r.doc_id, ids_of(BYTES, r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted((d or -1, i) for d, i in expected)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    some = token_files.read_token_files(index.filter("doc_id = 9")).collect()
    assert np.frombuffer(some[0].ids, "<u4").tolist() == dict(expected)[9]
    empty = token_files.write_token_files(no_docs, shared_path(spark, "t"), BYTES, 2)
    assert token_files.read_token_files(empty).collect() == []


def test_archives(spark):
    rows = [(1, "http://a/", "x"), (2, "http://b/\n", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70000)]
    rows += [(6, "u", "x"), (6, "u", "x"), (None, "u", "x"), (None, "v", "lonely"), (8, "w", "once\r\n\r\nagain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(pages, shared_path(spark, "w"), frame_bytes=1 << 16)
    found = warc.read_archives(index).collect()
    assert len(found) == len(rows)
    first = {"x": 1, "": 3}
    for page_id, _url, html in rows:
        body = (html or "").encode()
        for r in (r for r in found if r.page_id == page_id and (page_id is not None or (html == "lonely") == (r.record_type == "response"))):
            other = first.get(html or "")
            revisit = other is not None and other != page_id
            assert (r.record_type, r.refers_to) == (("revisit", other) if revisit else ("response", None))
            assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert r.payload_bytes == len(body) and r.payload == (None if revisit else body)
    one = warc.read_archives(index.filter("page_id = 8")).collect()
    assert [r.payload for r in one] == [b"once\r\n\r\nagain"]
    kinds = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, shared_path(spark, "w"), 2)).collect()}
    assert kinds[2] == "response"
    assert warc.read_archives(warc.write_archives(pages.filter("false"), shared_path(spark, "w"))).count() == 0


def test_media_columns(docs, no_docs):
    rows = media.with_index(media.with_media(docs, "text")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        payload = media.pad((r.text or "").encode())
        assert r.track.payload == payload and len(payload) % 192 == 0
        assert r.track.duration == len(payload) and r.track.codec == "raw" and r.track.samples == len(payload) // 192
        assert len(r.track.keyframes) == -(-r.track.samples // media.SYNC_EVERY)
        for i, k in enumerate(r.track.keyframes):
            at = i * media.SYNC_EVERY * 192
            assert r.media[k.start : k.start + k.length] == payload[at : at + 192]
        assert r.lang is not None
    assert media.with_index(media.with_media(no_docs, "text")).count() == 0


def test_media_tables():
    sizes, chunks = [3, 5, 2, 7], [100, 300]
    table = media.box(
        b"moov",
        media.box(b"trak", media.box(b"mdia", media.full_box(b"mdhd", np.array([0, 0, 600, 1200, 0], ">u4").tobytes()), media.box(b"minf", media.box(
            b"stbl",
            media.full_box(b"stsd", bytes([0, 0, 0, 1]), media.box(b"mp4a", bytes(28))),
            media.full_box(b"stsz", np.array([0, 4, *sizes], ">u4").tobytes()),
            media.full_box(b"stsc", np.array([2, 1, 3, 1, 2, 1, 1], ">u4").tobytes()),
            media.full_box(b"co64", np.array([2], ">u4").tobytes(), np.array(chunks, ">u8").tobytes()),
        )))),
    )
    with pytest.raises(ValueError):
        media.describe(table[:-4])
    tail = media.box(b"mdat", bytes(range(200)) * 2) + table
    row = media.describe(tail)
    assert (row["codec"], row["timescale"], row["duration"], row["samples"]) == ("mp4a", 600, 1200, 4)
    assert [(k["start"], k["length"]) for k in row["keyframes"]] == [(100, 3), (103, 5), (108, 2), (300, 7)]
    assert row["payload"] == tail[100:110] + tail[300:307]


def test_packing(docs, no_docs):
    rows = packing.pack(docs, WORDS, 2, capacity=512, group_docs=4).collect()
    expected = sorted((r.doc_id or -1, ids_of(WORDS, r.text)) for r in docs.select("doc_id", "text").collect())
    pieces = sorted(rows, key=lambda r: (r.doc_id or -1, r.doc_tokens, r.start))
    assert sum(r.length for r in rows) == sum(len(i) for _, i in expected)
    for doc, ids in expected:
        mine = [r for r in pieces if (r.doc_id or -1) == doc and r.doc_tokens == len(ids)]
        for r in mine:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
        assert {r.start for r in mine} == set(range(0, len(ids), 512))
    for s in {r.sequence_id for r in rows}:
        mine = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in mine] == [sum(x.length for x in mine[:i]) for i in range(len(mine))]
        assert sum(r.length for r in mine) <= 512
    assert packing.pack(no_docs, WORDS, 2).count() == 0


def test_tournament_is_first_fit_decreasing():
    lengths = np.random.default_rng(1).integers(1, 101, 400).tolist()
    bins, expected = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, used in enumerate(bins) if used + lengths[i] <= 100), len(bins))
        if b == len(bins):
            bins.append(0)
        expected[i] = (b, bins[b])
        bins[b] += lengths[i]
    assert packing.first_fit_decreasing(lengths, 100) == expected
