"""Removal of passages that earlier documents hold, by relative Lempel-Ziv parsing.

A document is factored greedily against reference blocks: from a place, the longest match with a
document of smaller id is one factor, and the next one begins behind it.  A repeated window of `WINDOW` words
holds at most one factor boundary, because a factor that begins inside it reaches at least its end.  So the
windows inside a factor are repeated, those across a boundary are looked up, and there are no others.

Reference blocks hold no whole documents, since every document would then have to visit each block.
Every window has a 25-word anchor (its smallest hash); equal windows have equal anchors at equal
places.  Where an anchor occurs in several documents, the stretch of words that its windows span goes
to the block that owns the anchor, from every document that has it, and is factored there: no
other block can hold a factor for these windows.  An anchor with many different surroundings would
crowd its block; its windows go one by one to the blocks that own the windows.

  count    texts are dealt to portions; a portion tells the blocks how often it has each anchor;
  send     different stretches of a portion, as words, with the smallest id that has them;
  factor   a block indexes its stretches by sorted suffixes and factors each against smaller ids;
  cut      the portion removes the words of its repeated windows.

Words are compared as words; hashes only choose the block that compares them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .packed import bucket_slices, joined, mixed, pack_sorted, parted, squeezed, unpack_sorted, unsqueezed
from .rows import bring_back, set_aside
from .suffix_dedup import sliding

PORTION_BYTES = 4 << 20
WINDOW = 50
ANCHOR = 25
REACH = WINDOW - ANCHOR
CROWD = 256
LAST_ID = np.iinfo(np.int64).max
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACE_CODES = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SENT = "bucket long, portion long, sent binary"
BACK = "portion long, bucket long, step int, answer binary"


class Stretches(NamedTuple):
    """Runs of words of a portion, `first[i]` to `last[i]`, in the order in which they are sent."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    of: np.ndarray  # for every occurrence in the portion, the stretch that stands for it
    at: np.ndarray  # and its own first word
    later: np.ndarray  # whether a smaller id of the portion has the same words there


class Portion:
    """The words of some texts: `line` holds each followed by one space."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].to_pylist()
        self.ids = np.array([LAST_ID if i is None else i for i in ids], np.int64)
        texts = [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = SPACE[data]
        ends = np.flatnonzero(space & ~np.append(True, space[:-1]))
        self.doc_ends = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]))
        kept = ~space
        kept[ends] = True
        self.line = np.where(space, np.uint8(32), data)[kept]
        self.ends = np.flatnonzero(self.line == 32)
        self.starts = np.append(0, self.ends + 1)[:-1]
        self.doc = np.searchsorted(self.doc_ends, np.arange(len(self.ends)), side="right")

    def _sums(self) -> np.ndarray:
        """Prefix sums from which the hash of any run of words follows."""
        n = len(self.line)
        codes = BYTE_CODES[self.line]
        codes *= PLACE_CODES[(np.arange(n) - np.repeat(self.starts, self.ends - self.starts + 1)) & 63]
        words = mixed(np.add.reduceat(codes, self.starts)) if len(self.starts) else np.zeros(0, np.uint64)
        powers = np.full(len(words), STEP)
        self.unpowers = np.full(len(words), UNSTEP)
        if len(words):
            powers[0] = self.unpowers[0] = 1
        np.cumprod(self.unpowers, out=self.unpowers)
        return np.append(np.uint64(0), np.cumsum(words * np.cumprod(powers), dtype=np.uint64))

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed((self.sums[last] - self.sums[first]) * self.unpowers[first])

    def find_anchors(self) -> None:
        """Places and hashes of the anchors of all windows inside a document, in order of their hashes."""
        self.sums = self._sums()
        n = len(self.ends)
        if n < WINDOW:
            self.anchor, self.code = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        at = np.arange(n - ANCHOR + 1)
        code = self.hashes(at, at + ANCHOR) | np.uint64(1)
        least = sliding(np.minimum, code, REACH + 1)
        least[self.doc[: len(least)] != self.doc[WINDOW - 1 :]] = 0
        edge = np.zeros(REACH, np.uint64)
        chosen = sliding(np.maximum, np.concatenate([edge, least, edge]), REACH + 1) == code
        at = np.flatnonzero(chosen)
        order = np.argsort(code[at], kind="stable")
        self.anchor, self.code = at[order], code[at[order]]
        doc = self.doc[self.anchor]
        begin = np.append(0, self.doc_ends)[doc]
        self.first = np.maximum(self.anchor - REACH, begin)
        self.last = np.minimum(self.anchor + WINDOW, self.doc_ends[doc])

    def tally(self) -> tuple[np.ndarray, np.ndarray]:
        """Different anchors, and for each how many surroundings it has (at most 127), plus 128 if in several documents."""
        codes, which = np.unique(self.code, return_inverse=True)
        around = self.hashes(self.first, self.last)
        seen = np.unique(np.stack([which.astype(np.uint64), around], 1), axis=0)[:, 0]
        n = np.minimum(np.bincount(seen.astype(np.int64), minlength=len(codes)), 127)
        doc = self.ids[self.doc[self.anchor]]
        least, most = np.full(len(codes), LAST_ID), np.full(len(codes), np.iinfo(np.int64).min)
        np.minimum.at(least, which, doc)
        np.maximum.at(most, which, doc)
        return codes, (n | np.where(least < most, 128, 0)).astype(np.uint8)

    def stretches(self, state: np.ndarray) -> Stretches:
        """What to send, from the state of every different anchor: 0 in one document, 1 repeated, 2 crowded."""
        state = state[np.unique(self.code, return_inverse=True)[1]]
        once, crowded = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        first, last, key = self.first[once], self.last[once], self.code[once]
        lead = self.anchor[once] - first
        windows = [self.first[crowded] + k for k in range(REACH + 1)]
        windows = [w[(w <= self.anchor[crowded]) & (w + WINDOW <= self.last[crowded])] for w in windows]
        single = np.unique(np.concatenate(windows)) if windows else np.zeros(0, np.int64)
        first, last = np.append(first, single), np.append(last, single + WINDOW)
        key = np.append(key, self.hashes(single, single + WINDOW))
        lead = np.append(lead, np.full(len(single), -1))
        doc = self.ids[self.doc[first]] if len(first) else np.zeros(0, np.int64)
        order = np.lexsort((first, doc))
        line, seen, of, kept = self.line.tobytes(), {}, np.empty(len(order), np.int64), []
        begin, end = self.starts[first].tolist(), self.ends[last - 1].tolist()
        lead = lead.tolist()
        for i in order.tolist():
            words = (line[begin[i] : end[i]], lead[i])
            j = seen.get(words)
            if j is None:
                j = seen[words] = len(kept)
                kept.append(i)
            of[i] = j
        kept = np.array(kept, np.int64)
        by_key = np.lexsort((first[kept], last[kept], key[kept]))
        place = np.empty(len(kept), np.int64)
        place[by_key] = np.arange(len(kept))
        kept = kept[by_key]
        of = place[of]
        return Stretches(first[kept], last[kept], doc[kept], key[kept], of, first, doc > doc[kept][of])

    def sendable(self, s: Stretches, some: slice) -> bytes:
        lines = [self.line[a:b].tobytes() for a, b in zip(self.starts[s.first[some]], self.ends[s.last[some] - 1], strict=True)]
        size = (s.last[some] - s.first[some]).astype("u1")
        return squeezed([s.doc[some].tobytes(), size.tobytes(), pack_sorted(s.key[some]), b"\n".join(lines)])

    def repeated_words(self, s: Stretches, masks: np.ndarray) -> np.ndarray:
        """Which words go; bit i of a stretch's mask stands for the window that begins at its word i."""
        edges = np.zeros(len(self.ends) + 1, np.int32)
        windows = s.last[s.of] - s.first[s.of] - WINDOW
        mask = np.where(s.later, (np.int64(2) << windows) - 1, masks[s.of].astype(np.int64))
        for i in range(REACH + 1):
            start = s.at[mask >> i & 1 == 1] + i
            np.add.at(edges, start, 1)
            np.add.at(edges, start + WINDOW, -1)
        return np.cumsum(edges[:-1]) > 0


class Reference:
    """An indexed block: stretches of words in the order of their suffixes, every place linked to the nearest
    places of smaller ids before and behind it in that order; one of the two is its longest earlier match.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        # A word of its own behind every stretch, so that no match runs into the next one.
        self.stops = np.cumsum(sizes + 1) - 1
        n = len(words) + len(sizes)
        here = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.stops] = False
        here[inside] = words
        here[self.stops] = words.max(initial=0) + 1 + np.arange(len(sizes))
        self.doc = np.repeat(docs, sizes + 1)
        self.ranks, reach = [here.astype(np.int32)], 1
        while reach <= sizes.max(initial=0):
            beyond = np.append(here[reach:], np.zeros(min(reach, n), np.int64))
            here = np.unique(here * (here.max(initial=0) + 2 + n) + beyond, return_inverse=True)[1]
            self.ranks.append(here.astype(np.int32))
            reach *= 2
        self.order = np.argsort(here)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        doc = self.doc[self.order]
        before, behind = nearest_smaller(doc)[place], n - 1 - nearest_smaller(doc[::-1])[n - 1 - place]
        self.links = [np.append(self.order, -1)[x] for x in (before, behind)]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words follow alike at two places."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            length += (rank[a + length] == rank[b + length]).astype(np.int64) << level
        return length

    def longest(self, at: np.ndarray) -> np.ndarray:
        """Length of the longest match of each place with a smaller id."""
        length = np.zeros(len(at), np.int64)
        for link in self.links:
            some = np.flatnonzero(link[at] >= 0)
            length[some] = np.maximum(length[some], self._common(at[some], link[at[some]]))
        return length

    def repeated(self) -> np.ndarray:
        """Which places begin a repeated window, from the factors of all stretches, parsed side by side."""
        found = np.zeros(len(self.doc), bool)
        cursor, stop = np.append(0, self.stops + 1)[:-1], self.stops
        while True:
            go = cursor + WINDOW <= stop
            cursor, stop = cursor[go], stop[go]
            if not len(cursor):
                return found
            length = self.longest(cursor)
            inside = np.maximum(length - WINDOW + 1, 0)
            found[ranges(cursor, inside)] = True
            # Windows that begin in the factor and end behind it.
            fit = np.minimum(length, stop - WINDOW + 1 - cursor)
            across = ranges(cursor + inside, np.maximum(fit - inside, 0))
            found[across] = self.longest(across) >= WINDOW
            cursor = cursor + np.maximum(length, 1)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For every place the nearest one before it with a smaller value, or -1."""
    found = np.arange(len(values)) - 1
    looking = np.flatnonzero(found >= 0)
    while len(looking):
        looking = looking[values[found[looking]] >= values[looking]]
        found[looking] = found[found[looking]]
        looking = looking[found[looking] >= 0]
    return found


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _answers(group: pa.Table, step: int, values: np.ndarray, sizes: list[int]) -> pa.Table:
    """The values of each row of a block's group, in the order in which its portion asked."""
    parts = [squeezed([v.tobytes()]) for v in np.split(values, np.cumsum(sizes)[:-1])]
    return pa.table({
        "portion": group["portion"], "bucket": group["bucket"],
        "step": pa.array([step] * len(parts), pa.int32()), "answer": pa.array(parts, pa.binary()),
    })


def anchor_states(group: pa.Table, crowd: int) -> pa.Table:
    """0 for an anchor of one document, 1 for a repeated one, 2 for one with more than `crowd` surroundings."""
    parts = [parted(d) for d in group["sent"].to_pylist()]
    codes = [unpack_sorted(p[0]) for p in parts]
    tally = np.concatenate([np.frombuffer(p[1], np.uint8) for p in parts])
    which = np.unique(np.concatenate(codes), return_inverse=True)[1]
    repeated = (np.bincount(which) > 1) | (np.bincount(which, tally >> 7) > 0)
    crowded = np.bincount(which, tally & 127) > crowd
    state = (repeated.astype(np.uint8) + (repeated & crowded))[which]
    return _answers(group, 1, state, [len(c) for c in codes])


def factor_stretches(group: pa.Table) -> pa.Table:
    """A mask for every stretch: bit i for a repeated window at its word i.

    Of equal stretches of an anchor the one with the smallest id stands for all, and in larger ids every window is
    repeated.  Where an anchor has different stretches, they are indexed and factored.
    """
    parts = [unsqueezed(d) for d in group["sent"].to_pylist()]
    docs = [np.frombuffer(p[0], np.int64) for p in parts]
    doc, sizes = np.concatenate(docs), np.concatenate([np.frombuffer(p[1], np.uint8) for p in parts]).astype(np.int64)
    key = np.concatenate([unpack_sorted(p[2]) for p in parts])
    lines = pa.chunked_array([pc.split_pattern(pa.array([p[3]], pa.binary()), b"\n").flatten() for p in parts])
    line = lines.combine_chunks().dictionary_encode()
    order = np.lexsort((doc, line.indices.to_numpy(), key))
    new_key = np.diff(key[order], prepend=~key[order[:1]]) != 0
    first = np.flatnonzero(new_key | (np.diff(line.indices.to_numpy()[order], prepend=-1) != 0))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    anchor = np.cumsum(new_key)[first]
    first = order[first]
    several = np.flatnonzero(np.bincount(anchor)[anchor] > 1)

    chosen = first[several]
    text = line.dictionary.take(line.indices.take(pa.array(chosen)))
    words = pc.split_pattern(text, b" ").flatten().dictionary_encode().indices.to_numpy()
    block = Reference(words, sizes[chosen], doc[chosen])
    repeated = block.repeated()
    begin = np.append(0, block.stops + 1)[:-1]
    mask = np.zeros(len(first), np.uint32)
    for i in range(REACH + 1):
        mask[several] |= (repeated[np.minimum(begin + i, block.stops)]).astype(np.uint32) << np.uint32(i)
    every = (np.uint32(2) << (sizes - WINDOW).astype(np.uint32)) - np.uint32(1)
    return _answers(group, 2, np.where(doc > doc[first][which], every, mask[which]), [len(d) for d in docs])


def _read(answers: pa.Table, step: int, dtype: str) -> np.ndarray:
    rows = answers.filter(pc.equal(answers["step"], step)).sort_by("bucket")
    return np.frombuffer(b"".join(unsqueezed(d)[0] for d in rows["answer"].to_pylist()), dtype)


def _sent(portion: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    buckets, sent = zip(*rows, strict=True) if rows else ((), ())
    return pa.table({
        "bucket": pa.array(buckets, pa.int64()), "portion": pa.array([portion] * len(rows), pa.int64()),
        "sent": pa.array(sent, pa.binary()),
    })


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
RESULTS = [T.StructField("_words", T.LongType()), T.StructField("_kept", T.StringType()), T.StructField("_spans", SPANS)]


def _cut(table: pa.Table, portion: Portion, gone: np.ndarray) -> pa.Table:
    """The rows of a portion with their number of words, the words that stay and the runs that go."""
    size = portion.ends - portion.starts + 1
    line = portion.line[np.repeat(~gone, size)]
    words = np.diff(portion.doc_ends, prepend=0)
    kept_bytes = np.append(0, np.cumsum(size * ~gone))[portion.doc_ends]
    kept, spans, start, byte = [], [], 0, 0
    for stop, end in zip(portion.doc_ends.tolist(), kept_bytes.tolist(), strict=True):
        kept.append(line[byte : max(byte, end - 1)].tobytes().decode())
        edges = np.flatnonzero(np.diff(gone[start:stop], prepend=False, append=False))
        spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        start, byte = stop, end
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    columns = [pa.array(words, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pairs)]
    for field, column in zip(RESULTS, columns, strict=True):
        table = table.append_column(field.name, column)
    return table.drop_columns(["_portion"])


def remove_repeats(
    docs: DataFrame,
    words: str = "n_words",
    kept: str = "kept",
    spans: str = "spans",
    portion_bytes: int = PORTION_BYTES,
    crowd: int = CROWD,
) -> DataFrame:
    """All rows and columns of `docs` with the number of words of `text`, the words that stay, joined by a space,
    and the removed runs as word places.

    A word goes if a window of 50 words that covers it also starts in a row with a smaller `doc_id`, judged on
    the input.  Rows of one id are not earlier than each other; a null id is larger than all others.
    Null, empty and shorter texts lose nothing; a null text keeps ''.  Columns named like a result are
    replaced; an empty table gives no rows.  An anchor with more than `crowd` surroundings is split by windows.
    """
    docs, used = docs.drop(words, kept, spans), ["doc_id", "text"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = int(-(-size // portion_bytes)) or 1
    rows = set_aside(docs, used)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(portions)).alias("_portion")
    texts = rows.select("*", place).groupBy("_portion")

    def opened(table: pa.Table) -> tuple[pa.Table, Portion]:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        portion = Portion(table)
        portion.find_anchors()
        return table, portion

    def tell(table: pa.Table) -> pa.Table:
        _, portion = opened(table)
        codes, tally = portion.tally()
        rows = [(b, joined([pack_sorted(codes[s]), tally[s].tobytes()])) for b, s in bucket_slices(codes, portions)]
        return _sent(table["_portion"][0].as_py(), rows)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, portion = opened(table)
        found = portion.stretches(_read(answers, 1, "u1"))
        rows = [(b, portion.sendable(found, s)) for b, s in bucket_slices(found.key, portions)]
        return _sent(table["_portion"][0].as_py(), rows)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, portion = opened(table)
        found = portion.stretches(_read(answers, 1, "u1"))
        return _cut(table, portion, portion.repeated_words(found, _read(answers, 2, "<u4")))

    def answer(group: pa.Table) -> pa.Table:
        return anchor_states(group, crowd)

    states = cut_lineage(texts.applyInArrow(tell, SENT).groupBy("bucket").applyInArrow(answer, BACK))
    sent = texts.cogroup(states.groupBy("portion")).applyInArrow(send, SENT)
    masks = cut_lineage(sent.groupBy("bucket").applyInArrow(factor_stretches, BACK))
    schema = T.StructType([*rows.schema, *RESULTS])
    done = texts.cogroup(states.union(masks).groupBy("portion")).applyInArrow(cut, schema)
    results = [F.col(f.name).alias(n) for f, n in zip(RESULTS, (words, kept, spans), strict=True)]
    return done.select(*bring_back(docs.columns, used), *results)
