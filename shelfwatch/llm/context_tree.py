"""Context-tree weighting over bytes, learned and applied by blocks of documents.

A byte is coded as eight binary decisions, each with a context tree of its own over the
preceding bytes.  Every node of a tree has a Krichevsky-Trofimov estimate of its bits; its
weighted probability is half that estimate plus half the product of its children's, so all
depths are mixed.  Estimates depend on counts alone, which makes learning a sum over the
corpus: blocks count their distinct windows (a byte with its context), equal windows are
added, the trees are weighted from the leaves to the root, and a text's code length is the
sum over its windows of a probability mixed along the path.  A context that was not seen in
learning ends the path: the mixture stops at the deepest one that was.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import bucket_slices, mixed, pack_counts, pack_sorted, squeezed, unpack_counts, unpack_sorted, unsqueezed

DEPTH = 6
BLOCK_BYTES = 8 << 20
TREE_GROUPS = 512
FOLDS = 10
END = 255
WINDOWS, WORDS, TOTALS = 0, 1, 2
ASKED = "kind int, bucket long, block long, asked binary"
ANSWERED = "kind int, block long, bucket long, answer binary"
COUNTED = "grove int, bucket long, counted binary"
SMALL = 1 << 12
CHUNK = 1 << 16


def _log_gammas(half: float) -> np.ndarray:
    return np.cumsum(np.concatenate([[np.log(np.pi) / 2 if half == 0.5 else 0.0], np.log(np.arange(SMALL - 1) + half)]))


LOG_GAMMAS = {half: _log_gammas(half) for half in (0.5, 1.0)}


def log_gamma_halves(n: np.ndarray, half: float) -> np.ndarray:
    """log Gamma(n + half) for whole n >= 0, by a table and Stirling's series beyond it."""
    out = LOG_GAMMAS[half][np.minimum(n, SMALL - 1).astype(np.int64)]
    large = n >= SMALL
    x = n[large] + half
    out[large] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    gammas = log_gamma_halves(zeros, 0.5) + log_gamma_halves(ones, 0.5)
    return gammas - log_gamma_halves(zeros + ones, 1.0) - np.log(np.pi)


def windows(padded: np.ndarray, depth: int) -> np.ndarray:
    """Every byte from `depth` on with its context: the nearest context byte leads, the byte comes last."""
    n = len(padded) - depth
    out = np.empty(n, np.uint64)
    for at in range(0, n, CHUNK):
        size = min(CHUNK, n - at)
        part = padded[at + depth : at + depth + size].astype(np.uint64)
        for d in range(1, depth + 1):
            start = at + depth - d
            part |= padded[start : start + size].astype(np.uint64) << np.uint64(8 * (depth + 1 - d))
        out[at : at + size] = part
    return out


class Trees:
    """The context trees of a set of windows for one of the eight decisions, from `top` contexts down."""

    def __init__(self, window: np.ndarray, count: np.ndarray, decision: int, depth: int):
        byte = window & np.uint64(255)
        self.node = (np.uint64(1 << decision) | byte >> np.uint64(8 - decision)).astype(np.int64)
        self.bit = (byte >> np.uint64(7 - decision) & np.uint64(1)).astype(np.int64)
        key = self.node.astype(np.uint64) << np.uint64(8 * depth) | window >> np.uint64(8)
        self.order = np.argsort(key)
        self.key, self.depth = key[self.order], depth
        ones = np.where(self.bit == 1, count, 0)[self.order]
        self.starts, self.zeros, self.ones, self.estimate, self.weighted = {}, {}, {}, {}, {}
        level, zeros, ones = np.arange(len(key)), count[self.order] - ones, ones
        for d in range(depth, -1, -1):
            head = self.key[level] >> np.uint64(8 * (depth - d))
            first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
            zeros, ones = np.add.reduceat(zeros, first), np.add.reduceat(ones, first)
            own = log_estimate(zeros, ones)
            if d < depth:
                own_and = np.add.reduceat(self.weighted[d + 1], first)
                self.weighted[d] = np.log(0.5) + np.logaddexp(own, own_and)
            else:
                self.weighted[d] = own
            level = level[first]
            self.starts[d], self.zeros[d], self.ones[d], self.estimate[d] = level, zeros, ones, own

    def spread(self, values: np.ndarray, d: int) -> np.ndarray:
        """Values of the nodes at a depth, for every window in sorted order."""
        return np.repeat(values, np.diff(np.append(self.starts[d], len(self.key))))

    def nodes(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Decision node and nearest context byte of the nodes at a depth of at least 1."""
        key = self.key[self.starts[d]]
        return (key >> np.uint64(8 * self.depth)).astype(np.int64), (key >> np.uint64(8 * self.depth - 8) & np.uint64(255)).astype(np.int64)

    def mix(self, below: int, top: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
        """Probability of each window's bit, in the windows' own order.

        Depths of at least `below` are this object's own; `top` has (zeros, ones, estimate,
        weighted) per window in sorted order for the others.
        """
        bit, q, seen = self.bit[self.order], None, None
        for d in range(self.depth, -1, -1):
            if d >= below:
                zeros, ones, own, weighted = (
                    self.spread(v[d], d) for v in (self.zeros, self.ones, self.estimate, self.weighted)
                )
            else:
                zeros, ones, own, weighted = top[d]
            n = zeros + ones
            estimate = (np.where(bit == 1, ones, zeros) + 0.5) / (n + 1)
            if q is None:
                q = estimate
            else:
                share = 0.5 * np.exp(own - weighted)
                q = np.where(seen, share * estimate + (1 - share) * q, estimate)
            seen = n > 0
        out = np.empty(len(q))
        out[self.order] = q
        return out


def groves(window: np.ndarray, depth: int) -> np.ndarray:
    """Group of the two nearest context bytes, whose subtrees are weighted together."""
    return (mixed(window >> np.uint64(8 * (depth - 1))) % np.uint64(TREE_GROUPS)).astype(np.int32)


def window_slices(window: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of distinct windows in order, per bucket of their hashes."""
    code = mixed(window)
    order = np.argsort(code)
    for bucket, s in bucket_slices(code[order], buckets):
        some = order[s]
        yield bucket, some[np.argsort(window[some])]


class Block:
    """The texts of one block, lower-cased: windows, words, and their learning counts."""

    def __init__(self, table: pa.Table, depth: int):
        text = pa.concat_arrays(table["text"].cast(pa.string()).chunks)
        text = pc.ascii_lower(pc.fill_null(text, ""))
        self.learn = table["_learn"].to_numpy()
        self._words(text)
        texts = text.cast(pa.binary()).to_pylist()
        self.lengths = np.array([len(t) + 1 for t in texts])
        self.begins = np.cumsum(self.lengths) - self.lengths
        gap = bytes([END]) * depth
        padded = np.frombuffer(b"".join(x for t in texts for x in (gap, t, gap[:1])), np.uint8)
        every = windows(padded, depth)
        self.windows = np.empty(int(self.lengths.sum()), np.uint64)
        at = 0
        for begin, length in zip(self.begins.tolist(), self.lengths.tolist(), strict=True):
            self.windows[begin : begin + length] = every[at : at + length]
            at += length + depth

    def _words(self, text: pa.Array) -> None:
        """Words by code and the text of each; the empty word is the end of a text."""
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
        text_of = np.repeat(np.arange(len(text)), pc.list_value_length(split).to_numpy())
        found = split.flatten().dictionary_encode()
        code, words = found.indices.to_numpy(), found.dictionary.cast(pa.binary()).to_pylist()
        if b"" in words:  # a text without words
            full = code != words.index(b"")
            code, text_of = code[full], text_of[full]
        else:
            words.append(b"")
        self.words, self.end = words, words.index(b"")
        ends = np.full(len(text), self.end, code.dtype)
        self.word_code = np.concatenate([code, ends])
        self.text_of = np.concatenate([text_of, np.arange(len(text))])

    def window_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows and how often each occurs in texts to learn from."""
        tagged = self.windows << np.uint64(1)
        tagged |= np.repeat(~self.learn, self.lengths)
        tagged.sort()
        every = tagged >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        return every[first], np.add.reduceat((tagged & np.uint64(1) == 0).astype(np.int64), first)

    def window_codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows and for every window its place among these."""
        found = pa.array(self.windows).dictionary_encode()
        return found.dictionary.to_numpy(), found.indices.to_numpy()

    def word_counts(self) -> np.ndarray:
        """How often each distinct word occurs in texts to learn from."""
        return np.bincount(self.word_code[self.learn[self.text_of]], minlength=len(self.words))

    def word_slices(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Places of the distinct words in order, per bucket of their hashes."""
        code = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        order = np.argsort(code)
        for bucket, s in bucket_slices(code[order], buckets):
            yield bucket, np.array(sorted(order[s].tolist(), key=self.words.__getitem__))


def _rows(names_types: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names_types)
    return pa.table({n: pa.array(list(c), t) for (n, t), c in zip(names_types, columns, strict=True)})


ASKED_TYPES = [("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("asked", pa.binary())]
ANSWER_TYPES = [("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())]
MODEL_TYPES = [("kind", pa.int32()), ("bucket", pa.int64()), ("model", pa.binary())]
COUNT_TYPES = [("grove", pa.int32()), ("bucket", pa.int64()), ("counted", pa.binary())]


def score_texts(docs: DataFrame, depth: int = DEPTH, folds: int = FOLDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all rows of `doc_id, text` by a model of the rows outside the held-out fold.

    A row is held out if crc32(doc_id as text) mod `folds` is 0; a row with a null id is not.  A-Z
    are lower-cased; a null text is empty.  Returns per row `doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, n_bytes, bits_per_byte`: `score` is the log10 probability of
    the text and its end (a sum over its bytes of values in single precision), `base_score` that of its words and its end under smoothed word
    counts.  Without rows to learn from every bit has probability 1/2.  Repeated rows count as
    often as they occur; an empty table gives no rows.  Other columns are not read.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-size // block_bytes)) or 1
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("_block")
    texts = docs.select("doc_id", "text", (~held_out).alias("_learn"), place).groupBy("_block")

    def ask(table: pa.Table) -> pa.Table:
        block, number = Block(table, depth), table["_block"][0].as_py()
        (window, count), rows = block.window_counts(), []
        for b, some in window_slices(window, blocks):
            rows.append((WINDOWS, b, number, squeezed([pack_sorted(window[some]), pack_counts(count[some])])))
        count = block.word_counts()
        for b, some in block.word_slices(blocks):
            words = b"\n".join([block.words[i] for i in some.tolist()])
            rows.append((WORDS, b, number, squeezed([words, pack_counts(count[some])])))
        return _rows(ASKED_TYPES, rows)

    def count_windows(group: pa.Table) -> pa.Table:
        """Adds the counts of equal windows and deals them to the groves of the trees."""
        if group["kind"][0].as_py() != WINDOWS:
            return _rows(COUNT_TYPES, [])
        parts = [unsqueezed(d) for d in group["asked"].to_pylist()]
        every = np.concatenate([unpack_sorted(p[0]) for p in parts])
        times = np.concatenate([unpack_counts(p[1]) for p in parts])
        window, at = np.unique(every, return_inverse=True)
        count = np.bincount(at, times).astype(np.int64)
        grove = groves(window, depth)
        order = np.argsort(grove, kind="stable")
        starts = np.flatnonzero(np.diff(grove[order], prepend=-1))
        rows = []
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            some = order[a:b]
            data = squeezed([pack_sorted(window[some]), count[some].astype("<i8").tobytes()])
            rows.append((int(grove[some[0]]), group["bucket"][0].as_py(), data))
        return _rows(COUNT_TYPES, rows)

    def count_words(group: pa.Table) -> pa.Table:
        """Learning counts of the words that each block asked about; and, once per bucket, its totals."""
        if group["kind"][0].as_py() != WORDS:
            return _rows(ANSWER_TYPES, [])
        total: Counter[bytes] = Counter()
        asked = []
        for data in group["asked"].to_pylist():
            words, times = unsqueezed(data)
            asked.append(words.split(b"\n"))
            for w, n in zip(asked[-1], unpack_counts(times).tolist(), strict=True):
                total[w] += n
        bucket = group["bucket"][0].as_py()
        rows = [
            (WORDS, b, bucket, squeezed([np.fromiter((total[w] for w in words), "<i8", len(words)).tobytes()]))
            for b, words in zip(group["block"].to_pylist(), asked, strict=True)
        ]
        kinds = sum(n > 0 for n in total.values())
        return _rows(ANSWER_TYPES, [*rows, (TOTALS, -1, bucket, f"{total.total()} {kinds}".encode())])

    def grove_windows(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [unsqueezed(d) for d in group["counted"].to_pylist()]
        window = [unpack_sorted(p[0]) for p in parts]
        bucket = np.repeat(group["bucket"].to_numpy(), [len(w) for w in window])
        return np.concatenate(window), np.concatenate([np.frombuffer(p[1], "<i8") for p in parts]), bucket

    def weigh(group: pa.Table) -> pa.Table:
        """What a grove adds to the nodes of depth 1: counts and log weighted probabilities of their children."""
        window, count, _ = grove_windows(group)
        window, count = window[count > 0], count[count > 0]
        sums = np.zeros((256, 3, 256))
        for decision in range(8 if len(window) else 0):
            t = Trees(window, count, decision, depth)
            node, near = t.nodes(2)
            for i, v in enumerate((t.zeros[2], t.ones[2], t.weighted[2])):
                np.add.at(sums, (near, i, node), v)
        used = np.flatnonzero(sums[:, :2].any(axis=(1, 2)))
        return _rows([("near", pa.int32()), ("sums", pa.binary())], [(int(c), sums[c].tobytes()) for c in used])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d) for d in group["sums"].to_pylist())
        return pa.table({"near": group["near"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    def crown(group: pa.Table) -> pa.Table:
        """The nodes of depths 1 and 0: at most 256 rows, one per nearest context byte."""
        zeros, ones, below = np.stack([np.frombuffer(d).reshape(3, 256) for d in group["sums"].to_pylist()], axis=1)
        own = log_estimate(zeros, ones)
        weighted = np.log(0.5) + np.logaddexp(own, below)
        root_zeros, root_ones = zeros.sum(axis=0), ones.sum(axis=0)
        root = log_estimate(root_zeros, root_ones)
        root_weighted = np.log(0.5) + np.logaddexp(root, weighted.sum(axis=0))
        rows = [
            np.stack([zeros[i], ones[i], own[i], weighted[i], root_zeros, root_ones, root, root_weighted]).tobytes()
            for i in range(len(zeros))
        ]
        return pa.table({"one": pa.array([0] * len(rows), pa.int32()), "near": group["near"], "top": pa.array(rows, pa.binary())})

    def predict(group: pa.Table, tops: pa.Table) -> pa.Table:
        """Log10 probability of each window, dealt back to the windows' buckets."""
        if not group.num_rows:
            return _rows(MODEL_TYPES, [])
        window, count, bucket = grove_windows(group)
        near = (window >> np.uint64(8 * depth)).astype(np.int64)
        table = np.zeros((256, 8, 256))
        if tops.num_rows:
            known = np.stack([np.frombuffer(data).reshape(8, 256) for data in tops["top"].to_pylist()])
            table[:, 4:] = known[0, 4:]
            table[tops["near"].to_numpy()] = known
        out = np.zeros(len(window))
        for decision in range(8 if len(window) else 0):
            t = Trees(window, count, decision, depth)
            values = table[near[t.order], :, t.node[t.order]]
            out += np.log10(t.mix(2, {1: tuple(values[:, :4].T), 0: tuple(values[:, 4:].T)}))
        order = np.lexsort((window, bucket))
        b = bucket[order]
        starts = np.flatnonzero(np.diff(b, prepend=-1))
        rows = []
        for x, y in zip(starts, np.append(starts[1:], len(b)), strict=True):
            some = order[x:y]
            data = squeezed([pack_sorted(window[some]), out[some].astype("<f4").tobytes()])
            rows.append((WINDOWS, int(b[x]), data))
        return _rows(MODEL_TYPES, rows)

    def answer(group: pa.Table, model: pa.Table) -> pa.Table:
        """The model's values of the windows that each block asked about."""
        if not group.num_rows or group["kind"][0].as_py() != WINDOWS:
            return _rows(ANSWER_TYPES, [])
        parts = [unsqueezed(d) for d in model["model"].to_pylist()]
        window = np.concatenate([unpack_sorted(p[0]) for p in parts])
        order = np.argsort(window)
        window, value = window[order], np.concatenate([np.frombuffer(p[1], "<f4") for p in parts])[order]
        rows = []
        for b, bucket, data in zip(*(group[c].to_pylist() for c in ("block", "bucket", "asked")), strict=True):
            found = value[np.searchsorted(window, unpack_sorted(unsqueezed(data)[0]))]
            rows.append((WINDOWS, b, bucket, found.tobytes()))
        return _rows(ANSWER_TYPES, rows)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, depth)
        rows = answers.sort_by("bucket")
        kind = rows["kind"].to_numpy()
        of = {k: rows.filter(pa.array(kind == k))["answer"].to_pylist() for k in (WINDOWS, WORDS)}
        window, code = block.window_codes()
        value = np.empty(len(window))
        at = np.concatenate([some for _, some in window_slices(window, blocks)])
        value[at] = np.frombuffer(b"".join(of[WINDOWS]), "<f4")
        scores = np.add.reduceat(value[code], block.begins)
        counts = np.empty(len(block.words), np.int64)
        at = np.concatenate([some for _, some in block.word_slices(blocks)])
        counts[at] = np.frombuffer(b"".join(unsqueezed(d)[0] for d in of[WORDS]), "<i8")
        n = len(block.lengths)
        tokens = np.bincount(block.text_of, minlength=n)
        known = np.bincount(block.text_of[(counts > 0)[block.word_code]], minlength=n)
        base = np.bincount(block.text_of, np.log10(counts + 0.1)[block.word_code], n)
        return pa.table({
            "doc_id": table["doc_id"], "held_out": pa.array(~block.learn),
            "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "terms": pa.array(base, pa.float64()), "score": pa.array(scores),
            "n_bytes": pa.array(block.lengths - 1, pa.int64()),
        })

    asked = texts.applyInArrow(ask, ASKED)
    dealt = asked.groupBy("kind", "bucket")
    word_answers = dealt.applyInArrow(count_words, ANSWERED)
    grove = dealt.applyInArrow(count_windows, COUNTED).groupBy("grove")
    near = grove.applyInArrow(weigh, "near int, sums binary").groupBy("near").applyInArrow(add, "near int, sums binary")
    tops = near.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(crown, "one int, near int, top binary")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(TREE_GROUPS - 1)))
    tops = tops.withColumn("grove", numbers)
    model = grove.cogroup(tops.groupBy("grove")).applyInArrow(predict, "kind int, bucket long, model binary")
    window_answers = dealt.cogroup(model.groupBy("kind", "bucket")).applyInArrow(answer, ANSWERED)
    answers = window_answers.union(word_answers.filter(F.col("kind") == WORDS))
    scored = texts.cogroup(answers.groupBy("block")).applyInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, terms double, score double, n_bytes long",
    )
    pair = F.split(F.col("answer").cast("string"), " ").cast("array<long>")
    totals = word_answers.filter(F.col("kind") == TOTALS).agg(
        F.coalesce(F.sum(pair[0]), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum(pair[1]), F.lit(0)).alias("kinds")
    )
    rows = scored.crossJoin(F.broadcast(totals))
    base = F.col("terms") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.1 * (F.col("kinds") + 1))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", "n_bytes",
        bits.alias("bits_per_byte"),
    )

