"""Removal of byte strings that also start in an earlier document, by a depth-limited radix sort.

Suffixes are told apart by digits of decreasing significance, and after every pass those
that are alone drop out; equal groups at the threshold depth are the repeated windows.  Only
sampled suffixes are sorted: of every window of 50 bytes the 24-byte string with the smallest
hash is its anchor, so equal windows have equal anchors at equal places.

  pass 1   the anchor itself: which anchors occur in more than one document;
  pass 2   the anchor with all bytes of the windows around it: where an earlier document has the
           same, all its windows are repeated, and where an anchor has one context only, the work is done;
  pass 3   what is left: the windows at each offset around the anchor, by seven digits of eight bytes.

The passes over anchors and contexts compare 64-bit hashes of their bytes, pass 3 the bytes.

Texts are dealt once to blocks of bounded size.  A block asks about its distinct digits in
packed arrays, cut by the digit's leading bits; the answers come back in the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import bucket_slices, joined, mixed, pack_sorted, parted, unpack_sorted
from .rows import bring_back, set_aside

BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 1 << 17
WINDOW = 50
GRAM = 24
REACH = WINDOW - GRAM
LAST_ID = np.iinfo(np.int64).max
ASKED = "bucket long, block long, asked binary"
ANSWERED = "block long, bucket long, pass int, answer binary"
CONTEXT = np.dtype([("left", "u1"), ("right", "u1"), ("bytes", "u1", (REACH + WINDOW,))])
LANES = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(16)], np.uint64) | np.uint64(1)


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a byte matrix."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    lanes = wide.view("<u8")
    out = np.full(len(rows), rows.shape[1], np.uint64)
    for i in range(lanes.shape[1]):
        out += mixed(lanes[:, i] + LANES[i]) * LANES[i + 1]
    return mixed(out)


def equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a byte matrix that occur more than once, and the number of the group of each.

    Most-significant-digit passes: each sorts what is left inside its groups by the next eight bytes,
    splits the groups there and drops rows that are alone.
    """
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    digits = wide.view(">u8")
    live, group = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for column in range(digits.shape[1]):
        digit = digits[live, column].astype(np.uint64)
        order = np.lexsort((digit, group))
        live, group = live[order], _runs(group[order], digit[order])
        several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        live, group = live[several], group[several]
    return live, group


def sliding(take, values: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every `width` neighbours."""
    reach = 1
    while reach * 2 <= width:
        values = take(values[:-reach], values[reach:])
        reach *= 2
    return take(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


def anchors(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows that lie inside one document."""
    positions, hashes = [], []
    first, start = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, start + CHUNK_BYTES, side="right")))
        stop = int(ends[last - 1])
        p, h = _chunk_anchors(buffer[start:stop], ends[first:last] - start)
        positions.append(p + start)
        hashes.append(h)
        first, start = last, stop
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(positions), np.concatenate(hashes)


def _chunk_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, 0, (1,))
    grams = len(data) - GRAM + 1
    h = words[:grams] * LANES[0]
    h += words[8 : 8 + grams] * LANES[1]
    h += words[16 : 16 + grams] * LANES[2]
    h = mixed(h)
    h |= np.uint64(1)
    least = sliding(np.minimum, h, REACH + 1)
    for end in ends[:-1]:  # windows that cross into the next document
        least[max(0, end - WINDOW + 1) : end] = 0
    edge = np.zeros(REACH, np.uint64)
    chosen = sliding(np.maximum, np.concatenate([edge, least, edge]), REACH + 1) == h
    at = np.flatnonzero(chosen)
    return at, h[at]


def contexts(buffer: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes of all windows around each anchor, clipped to its document, with the clipped reaches."""
    doc = np.searchsorted(ends, at, side="right")
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(at), CONTEXT)
    left = np.minimum(REACH, at - starts[doc])
    right = np.minimum(REACH, ends[doc] - at - GRAM)
    out["left"], out["right"] = left, right
    padded = np.concatenate([np.zeros(REACH, np.uint8), buffer, np.zeros(REACH, np.uint8)])
    span = REACH + WINDOW
    rows = np.lib.stride_tricks.sliding_window_view(padded, span)
    for i in range(0, len(at), 1 << 15):
        out["bytes"][i : i + (1 << 15)] = rows[at[i : i + (1 << 15)]]
    for i in np.flatnonzero((left < REACH) | (right < REACH)):
        out["bytes"][i, : REACH - left[i]] = 0
        out["bytes"][i, span - REACH + right[i] :] = 0
    return out


class Block:
    """The texts of one block and what is known about their anchors."""

    def __init__(self, table: pa.Table):
        texts = [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        ids = table["doc_id"].to_pylist()
        self.ids = np.array([LAST_ID if i is None else i for i in ids], np.int64)
        self.at, self.hash = anchors(self.buffer, self.ends)
        self.doc = self.ids[np.searchsorted(self.ends, self.at, side="right")]
        self.grams, self.gram = np.unique(self.hash, return_inverse=True)

    def several(self) -> np.ndarray:
        """Whether each distinct anchor occurs in two documents of this block."""
        least, most = np.full(len(self.grams), LAST_ID), np.full(len(self.grams), np.iinfo(np.int64).min)
        np.minimum.at(least, self.gram, self.doc)
        np.maximum.at(most, self.gram, self.doc)
        return least != most

    def use_repeats(self, repeated: np.ndarray) -> None:
        """After pass 1: the anchors left, grouped by anchor and context, in the order of pass 2."""
        keep = np.flatnonzero(repeated[self.gram])
        shown = contexts(self.buffer, self.ends, self.at[keep])
        code = hash_rows(shown.view(np.uint8).reshape(len(shown), -1))
        order = np.lexsort((self.doc[keep], code, self.hash[keep]))
        self.kept, self.shown = keep[order], shown[order]
        gram, code = self.hash[self.kept], code[order]
        first = np.ones(len(gram), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (code[1:] != code[:-1])
        self.group = np.cumsum(first) - 1
        self.firsts = np.flatnonzero(first)
        self.asked_gram, self.asked_code = gram[first], code[first]
        self.asked_doc = self.doc[self.kept][first]
        self.later = self.doc[self.kept] > self.asked_doc[self.group]

    def use_contexts(self, answer: np.ndarray) -> None:
        """After pass 2: what is settled, and the contexts to ask about in pass 3."""
        self.settled = self.later | (answer == 1)[self.group]
        self.open = np.flatnonzero(answer == 2)

    def removed(self, masks: np.ndarray) -> np.ndarray:
        """After pass 3: which bytes go."""
        edges = np.zeros(len(self.buffer) + 1, np.int32)
        at = self.at[self.kept]
        whole = np.flatnonzero(self.settled)
        np.add.at(edges, at[whole] - self.shown["left"][whole], 1)
        np.add.at(edges, at[whole] + GRAM + self.shown["right"][whole], -1)
        mask = np.zeros(len(self.firsts), np.uint32)
        mask[self.open] = masks
        mask = np.where(self.settled, np.uint32(0), mask[self.group])
        for offset in range(REACH + 1):
            start = at[(mask >> np.uint32(offset)) & np.uint32(1) == 1] - offset
            np.add.at(edges, start, 1)
            np.add.at(edges, start + WINDOW, -1)
        return np.cumsum(edges[:-1]) > 0


def _asked(block: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({
        "bucket": pa.array([b for b, _ in rows], pa.int64()),
        "block": pa.array([block] * len(rows), pa.int64()),
        "asked": pa.array([d for _, d in rows], pa.binary()),
    })


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each sorted row lies in."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _answers(group: pa.Table, number: int, answers: list[bytes]) -> pa.Table:
    n = group.num_rows
    return pa.table({
        "block": group["block"], "bucket": group["bucket"],
        "pass": pa.array([number] * n, pa.int32()), "answer": pa.array(answers, pa.binary()),
    })


def answer_repeats(group: pa.Table) -> pa.Table:
    """Pass 1: a bit per distinct anchor of a block: it occurs in more than one document."""
    parts = [parted(d) for d in group["asked"].to_pylist()]
    grams = [unpack_sorted(p[0]) for p in parts]
    sizes = [len(g) for g in grams]
    several = np.concatenate([np.unpackbits(np.frombuffer(p[1], np.uint8), count=n) for p, n in zip(parts, sizes, strict=True)])
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    run = _runs(every[order])
    repeated = np.empty(len(every), np.uint8)
    repeated[order] = ((np.bincount(run) > 1) | (np.bincount(run, several[order]) > 0))[run]
    return _answers(group, 1, [np.packbits(r).tobytes() for r in np.split(repeated, np.cumsum(sizes)[:-1])])


def answer_contexts(group: pa.Table) -> pa.Table:
    """Pass 2: 1 where an earlier document has the context, 2 where the anchor has several, else 0."""
    parts = [parted(d) for d in group["asked"].to_pylist()]
    gram, code, doc = (np.concatenate([np.frombuffer(p[i], t) for p in parts]) for i, t in enumerate(("<u8", "<u8", "<i8")))
    order = np.lexsort((doc, code, gram))
    g, c, d = gram[order], code[order], doc[order]
    run, anchor = _runs(g, c), _runs(g)
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    contexts_of = np.bincount(anchor[starts])[anchor]
    state = np.where(d > d[starts][run], 1, np.where(contexts_of > 1, 2, 0)).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = state
    sizes = [len(p[0]) // 8 for p in parts]
    return _answers(group, 2, [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])])


def answer_windows(group: pa.Table) -> pa.Table:
    """Pass 3: a bit per offset around the anchor: an earlier document has that window."""
    parts = [parted(d) for d in group["asked"].to_pylist()]
    shown = np.concatenate([np.frombuffer(p[0], CONTEXT) for p in parts])
    doc = np.concatenate([np.frombuffer(p[1], "<i8") for p in parts])
    mask = np.zeros(len(doc), np.uint32)
    for offset in range(REACH + 1):
        some = np.flatnonzero((shown["left"] >= offset) & (shown["right"] >= REACH - offset))
        if not len(some):
            continue
        rows, same = equal_rows(shown["bytes"][some, REACH - offset : REACH - offset + WINDOW])
        order = np.lexsort((doc[some[rows]], same))
        rows, run = some[rows[order]], _runs(same[order])
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        found = rows[doc[rows] > doc[rows][starts][run]]
        mask[found] |= np.uint32(1 << offset)
    sizes = [len(p[1]) // 8 for p in parts]
    return _answers(group, 3, [x.tobytes() for x in np.split(mask, np.cumsum(sizes)[:-1])])


def _read(answers: pa.Table, number: int, dtype: str) -> bytes | np.ndarray:
    """The answers of one pass in the order in which the block asked."""
    rows = answers.filter(pa.array(answers["pass"].to_numpy() == number)).sort_by("bucket")
    parts = rows["answer"].to_pylist()
    return parts if dtype == "bits" else np.frombuffer(b"".join(parts), dtype)


def _repeated(block: Block, answers: pa.Table, buckets: int) -> np.ndarray:
    bits = _read(answers, 1, "bits")
    slices = [s for _, s in bucket_slices(block.grams, buckets)]
    found = [np.unpackbits(np.frombuffer(b, np.uint8), count=s.stop - s.start) for b, s in zip(bits, slices, strict=True)]
    return np.concatenate(found).astype(bool) if found else np.zeros(0, bool)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def _cut(table: pa.Table, block: Block, removed: np.ndarray, whole_characters: bool) -> pa.Table:
    """The rows of a block with the bytes that stay and the runs that go."""
    kept, spans, start = [], [], 0
    for end in block.ends:
        text, gone = block.buffer[start:end], removed[start:end]
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        a, b = edges[::2], edges[1::2]
        if whole_characters and len(a):
            heads = np.append(np.flatnonzero(text & 0xC0 != 0x80), len(text))
            a = heads[np.searchsorted(heads, a)]
            b = heads[np.searchsorted(heads, b, side="right") - 1]
            a, b = a[a < b], b[a < b]
        spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(a, b, strict=True)])
        stay = np.ones(len(text), bool)
        for x, y in zip(a, b, strict=True):
            stay[x:y] = False
        kept.append(text[stay].tobytes())
        start = end
    pa.default_memory_pool().release_unused()
    frame = table.drop_columns(["_block"])
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return frame.append_column("_kept", pa.array(kept, pa.binary())).append_column("_spans", pa.array(spans, pairs))


def remove_repeats(
    docs: DataFrame, kept: str = "kept", spans: str = "spans", whole_characters: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All rows and columns of `docs`, with the bytes that stay (`kept`) and the removed runs (`spans`).

    A byte of `text` (UTF-8) goes if a 50-byte string that covers it also starts in a row with a
    smaller `doc_id`, judged on the input.  Rows with equal ids do not count as earlier than each
    other; a null id counts as larger than all.  Null, empty and shorter texts lose nothing.
    With `whole_characters` the runs are shrunk to whole characters, so `kept` stays UTF-8.
    Columns of `docs` named like the two results are replaced.  An empty table gives no rows.
    """
    docs, used = docs.drop(kept, spans), ["doc_id", "text"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-size // block_bytes)) or 1
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("_block")
    rows = set_aside(docs, used)
    texts = rows.select("*", place).groupBy("_block")
    schema = T.StructType([*rows.schema, T.StructField("_kept", T.BinaryType()), T.StructField("_spans", SPANS)])

    def ask_repeats(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        block = Block(table)
        several = block.several()
        rows = [
            (b, joined([pack_sorted(block.grams[s]), np.packbits(several[s]).tobytes()]))
            for b, s in bucket_slices(block.grams, blocks)
        ]
        return _asked(table["_block"][0].as_py(), rows)

    def ask_contexts(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        block.use_repeats(_repeated(block, answers, blocks))
        fields = (block.asked_gram, block.asked_code, block.asked_doc)
        rows = [(b, joined([f[s].tobytes() for f in fields])) for b, s in bucket_slices(block.asked_gram, blocks)]
        return _asked(table["_block"][0].as_py(), rows)

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        block.use_repeats(_repeated(block, answers, blocks))
        block.use_contexts(_read(answers, 2, "u1"))
        shown, doc = block.shown[block.firsts[block.open]], block.asked_doc[block.open]
        rows = [
            (b, joined([shown[s].tobytes(), doc[s].tobytes()]))
            for b, s in bucket_slices(block.asked_gram[block.open], blocks)
        ]
        return _asked(table["_block"][0].as_py(), rows)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        block.use_repeats(_repeated(block, answers, blocks))
        block.use_contexts(_read(answers, 2, "u1"))
        removed = block.removed(_read(answers, 3, "<u4"))
        return _cut(table, block, removed, whole_characters)

    asked = texts.applyInArrow(ask_repeats, ASKED)
    answers = asked.groupBy("bucket").applyInArrow(answer_repeats, ANSWERED)
    for ask, answer in ((ask_contexts, answer_contexts), (ask_windows, answer_windows)):
        asked = texts.cogroup(answers.groupBy("block")).applyInArrow(ask, ASKED)
        answers = answers.union(asked.groupBy("bucket").applyInArrow(answer, ANSWERED))
    done = texts.cogroup(answers.groupBy("block")).applyInArrow(cut, schema)
    results = [F.col("_kept").alias(kept), F.col("_spans").alias(spans)]
    return done.select(*bring_back(docs.columns, used), *results)
