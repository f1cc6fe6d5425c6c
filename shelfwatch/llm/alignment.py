"""Alignment of two tokenizations of the same texts, by pointer jumping.

Both tokenizations cut the same bytes.  Every token points to its farthest-right overlapping token
of the other side; a token that ends where a token of the other side ends is as far right as it gets,
and of the two the one of side B is terminal.  Successors are doubled until nothing moves, and every
token then holds the terminal token of its group.  All texts of a portion are one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import bring_back, set_aside
from .tokens import Encoder, byte_letters

CHUNK_CHARS = 1 << 18
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "groups", "links"]
COUNTS = "a_id long, b_id long, n long"


class ByteSide(Encoder):
    """A byte-level vocabulary; the strings of its special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self._tokenizer.encode_special_tokens = True
        self._special = []
        byte_of = {letter: i for i, letter in enumerate(byte_letters())}
        tokens = [self._tokenizer.id_to_token(i) or "" for i in range(self._tokenizer.get_vocab_size())]
        self.bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.encode(t), self._type).astype(np.int64) for t in texts]


class PieceSide:
    """A vocabulary of pieces that adds the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self._model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self._model.encode([t[1:] for t in texts], num_threads=1)
        return [np.array(x, np.int64) for x in found]


class Pair:
    """Two vocabularies and what the alignment needs of them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in s.bytes]) for s in (self.a, self.b))
        largest = max(len(self.a_size), len(self.b_size))
        self.width = 2 if largest <= 1 << 16 else 4
        digits = np.char.encode(np.arange(largest).astype(str))
        self.n_digits = np.char.str_len(digits)
        self.digits = digits.view(np.uint8).reshape(largest, -1)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides, None where a side's bytes are not those of the text."""
        a, b = self.a.ids(texts), self.b.ids(texts)
        out = []
        for text, x, y in zip(texts, a, b, strict=True):
            same = all(
                b"".join(map(side.bytes.__getitem__, ids.tolist())) == text.encode()
                for side, ids in ((self.a, x), (self.b, y))
            )
            out.append((x, y) if same else None)
        return out


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal token of every token of A and of B, as places in B, from the tokens' ends."""
    n = len(a_end)
    over_a = np.searchsorted(a_end, b_end)
    ends_here = a_end[over_a] == b_end
    own = n + np.arange(len(b_end))
    succ = np.concatenate([n + np.searchsorted(b_end, a_end), np.where(ends_here, own, over_a)])
    while True:
        farther = succ[succ]
        if (farther == succ).all():
            return succ[:n] - n, succ[n:] - n
        succ = farther


def _rendered(pair: Pair, ids: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with the separator that follows it, and their lengths; `key` is twice the group plus the side."""
    n = len(ids)
    size = pair.n_digits[ids]
    rows = np.zeros((n, pair.digits.shape[1] + 1), np.uint8)
    rows[:, :-1] = pair.digits[ids]
    last = np.append(key[1:] != key[:-1], True)
    rows[np.arange(n), size] = np.where(last, np.where(key & 1, ord(";"), ord("|")), ord(","))
    return rows[np.arange(rows.shape[1]) <= size[:, None]], size + 1


def align_texts(pair: Pair, texts: list[str | None]) -> list[tuple[int, int, int, int, str, bytes]]:
    """The results of each text, in their order."""
    some = [i for i, t in enumerate(texts) if t]
    encoded = pair.encode([" " + texts[i] for i in some])
    found = {i: e for i, e in zip(some, encoded, strict=True) if e is not None}
    nothing = (0, 0, 0, 0, "", b"")
    if not found:
        return [nothing] * len(texts)
    sides = [np.concatenate(x) for x in zip(*found.values(), strict=True)]
    ids = np.concatenate(sides)
    a_end, b_end = np.cumsum(pair.a_size[sides[0]]), np.cumsum(pair.b_size[sides[1]])
    a_last, b_last = terminals(a_end, b_end)
    closing = np.flatnonzero(b_last == np.arange(len(b_last)))
    a_group, b_group = np.searchsorted(closing, a_last), np.searchsorted(closing, b_last)
    link_a, link_b = sides[0][np.searchsorted(a_end, b_end[closing])], sides[1][closing]

    key = np.concatenate([2 * a_group, 2 * b_group + 1])
    order = np.argsort(key, kind="stable")
    shown, size = _rendered(pair, ids[order], key[order])
    counts = np.array([[len(x), len(y)] for x, y in found.values()])
    token_ends = np.cumsum(counts.sum(axis=1))
    text_ends = np.cumsum(size)[token_ends - 1]
    group_ends = b_group[np.cumsum(counts[:, 1]) - 1] + 1
    dtype, text, group = f"<u{pair.width}", 0, 0
    out = [nothing] * len(texts)
    for i, (n_a, n_b), text_end, group_end in zip(found, counts.tolist(), text_ends.tolist(), group_ends.tolist(), strict=True):
        n = group_end - group
        pairs = b"".join(x[group:group_end].astype(dtype).tobytes() for x in (link_a, link_b))
        groups = shown[text : text_end - 1].tobytes().decode("ascii")
        out[i] = (n_a, n_b, n, n, groups, bytes([pair.width]) + pairs)
        text, group = text_end, group_end
    return out


def unpack_links(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of A and of B of a text's links."""
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64).reshape(2, -1)
    return both[0], both[1]


_PAIRS: dict[tuple[str, str], Pair] = {}


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """All rows and columns of `docs` with the alignment of `text` under two vocabularies.

    A is a byte-level file of the tokenizers library and encodes a space and the text; B is a
    sentencepiece file, which adds that space itself.  The results are the numbers of tokens `n_a` and
    `n_b`, of groups between common ends `n_groups` and of linked token pairs `n_links` (tokens are
    never empty, so one pair ends a group), the `groups` as text (`a1,a2|b1;a3|b2,b3`) and the packed
    `links` (see `unpack_links`).  A text that is null or empty, or that a vocabulary does not give back
    byte for byte, has no tokens: zeros and empty results.  Rows are taken one by one, so ids may be
    null and rows may repeat; columns named like a result are replaced; an empty table gives no rows.
    """
    docs, used = docs.drop(*RESULTS), ["text"]
    rows = set_aside(docs, used)
    kinds = [T.LongType()] * 4 + [T.StringType(), T.BinaryType()]
    schema = T.StructType([*rows.schema, *[T.StructField(n, k) for n, k in zip(RESULTS, kinds, strict=True)]])
    arrow = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _PAIRS.setdefault((a_path, b_path), None) or Pair(a_path, b_path)
        _PAIRS[a_path, b_path] = pair
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = np.cumsum([len(t or "") for t in texts]) // CHUNK_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)] if texts else [0]
            for start, stop in zip(cuts, cuts[1:]):
                columns = zip(*align_texts(pair, texts[start:stop]), strict=True)
                found = [pa.array(list(c), type=k) for c, k in zip(columns, arrow, strict=True)]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *RESULTS])
        pair.a.release()

    return rows.mapInArrow(run, schema).select(*bring_back(docs.columns, used), *RESULTS)


def link_counts(aligned: DataFrame) -> DataFrame:
    """`a_id, b_id, n`: how many links of all rows hold each pair of ids; counted per batch before the exchange.

    Two linked tokens end with the same byte, so the shorter one is a suffix of the longer: there are
    at most as many pairs as the tokens of both vocabularies have bytes, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [unpack_links(x) for x in batch.column(0).to_pylist() if x]
            if links:
                a, b = (np.concatenate(x) for x in zip(*links, strict=True))
                code, n = np.unique(b << 32 | a, return_counts=True)
                yield pa.RecordBatch.from_pydict({"a_id": code & 0xFFFFFFFF, "b_id": code >> 32, "n": n.astype(np.int64)})

    return aligned.select("links").mapInArrow(count, COUNTS).groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds `n_best`, the links whose pair is the most frequent one of its B id (ties included), and
    `count_sum`, the sum of the links' counts.  `counts` is bounded by the vocabularies, so all tasks get it.
    """
    table = counts.toArrow()
    a, b, n = (table[c].to_numpy() for c in ("a_id", "b_id", "n"))
    code = b << 32 | a
    order = np.argsort(code)
    best = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
    np.maximum.at(best, b, n)
    shared = aligned.sparkSession.sparkContext.broadcast((code[order], n[order], (n == best[b])[order]))
    aligned = aligned.drop("n_best", "count_sum")
    rows = set_aside(aligned, ["links"])
    schema = T.StructType([*rows.schema, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, top = shared.value
        for batch in batches:
            n_best, count_sum = [], []
            for packed in batch.column("links").to_pylist():
                a, b = unpack_links(packed or b"")
                at = np.searchsorted(codes, b << 32 | a)
                n_best.append(int(top[at].sum()))
                count_sum.append(int(n[at].sum()))
            columns = [*batch.columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_best", "count_sum"])

    return rows.mapInArrow(score, schema).select(*bring_back(aligned.columns, ["links"]), "n_best", "count_sum")
