"""SimHash fingerprints and exact search of close ones with vantage points.

Two fingerprints that differ in at most 4 of 64 bits agree on at least two of six bands, so
every pair of bands is a table of shards in which close fingerprints meet.  Inside a shard
the fingerprints are partitioned by their distance to a vantage point: a shell holds eight
distances, and by the triangle inequality a fingerprint only has to be compared with its own
shell and, if it lies within 4 of the lower edge, with the shell below, to which it is sent
as a guest.  Large shells are divided further by vantage-point trees in their task.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import scan_number, spread_join
from ..session import cut_lineage
from .components import components, spanning_links
from .groups import group_starts, whole_groups
from .packed import mixed, pack_sorted, unpack_sorted
from .rows import bring_back, set_aside

MAX_BITS = 4
BANDS = 6
SHELL = 2 * MAX_BITS
LEAF = 128
PAIRS = 1 << 14


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `words` words, joined by single spaces; of the whole text if it is shorter."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, hash_ = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hash_(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.fromiter((hash_(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in more than half of the hashes; zero without hashes.  Signed."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str, out: str, words: int = 4, seed: int = 42) -> DataFrame:
    """Adds the 64-bit fingerprint of the shingles of `words` words; null and wordless texts have zero."""

    @F.arrow_udf(returnType="long")
    def column(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(shingle_hashes(t or b"", words, seed)) for t in texts.to_pylist()], pa.int64())

    return df.withColumn(out, column(F.col(text).cast("binary")))


def band_keys(fingerprint: Column, bands: int = BANDS) -> list[Column]:
    """One number per pair of bands: the pair's index above the two bands' bits."""
    edges = [64 * i // bands for i in range(bands + 1)]
    parts = [(F.shiftrightunsigned(fingerprint, a).bitwiseAND((1 << (b - a)) - 1), b - a) for a, b in zip(edges, edges[1:])]
    return [
        F.shiftleft(F.lit(i).cast("long"), 40).bitwiseOR(F.shiftleft(x, n)).bitwiseOR(y)
        for i, ((x, _), (y, n)) in enumerate(combinations(parts, 2))
    ]


class Shell:
    """Fingerprints of one shell; links those that are close, comparing home with all."""

    def __init__(self, points: np.ndarray, home: np.ndarray, check: np.ndarray | None, check_bits: int):
        self.points, self.home, self.check, self.check_bits = points, home, check, check_bits
        self.label = np.arange(len(points))
        self.met = np.zeros(len(points), bool)

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merges the labels of the close pairs between two sets of positions."""
        close = np.bitwise_count(self.points[a][:, None] ^ self.points[b][None, :]) <= MAX_BITS
        close &= self.home[a][:, None] | self.home[b][None, :]
        close &= a[:, None] != b[None, :]
        self.met[a] |= close.any(axis=1)
        self.met[b] |= close.any(axis=0)
        x, y = np.nonzero(close)
        for i in range(0, len(x), PAIRS):
            self._merge(a[x[i : i + PAIRS]], b[y[i : i + PAIRS]])

    def _merge(self, x: np.ndarray, y: np.ndarray) -> None:
        keep = self.label[x] != self.label[y]
        x, y = x[keep], y[keep]
        if self.check is not None and len(x):
            keep = np.bitwise_count(self.check[x] ^ self.check[y]).sum(axis=1, dtype=np.int64) <= self.check_bits
            x, y = x[keep], y[keep]
        if len(x):
            nodes, roots = spanning_links(self.label[x], self.label[y])
            to = np.arange(len(self.label))
            to[nodes] = roots
            self.label = to[self.label]

    def split(self, positions: np.ndarray, vantage: np.uint64) -> tuple[np.ndarray, ...]:
        """Near and far half by distance to a vantage point, and the parts of both next to the edge."""
        distance = np.bitwise_count(self.points[positions] ^ vantage)
        edge = np.sort(distance)[(len(distance) - 1) // 2]
        near, far = distance <= edge, distance > edge
        return (
            positions[near], positions[far],
            positions[near & (distance > int(edge) - MAX_BITS)], positions[far & (distance <= int(edge) + MAX_BITS)],
        )

    def inside(self, s: np.ndarray) -> None:
        """All close pairs of a set: those of its halves and those across the edge."""
        if len(s) <= LEAF:
            return self.compare(s, s)
        near, far, near_edge, far_edge = self.split(s, self.points[s[0]])
        if not len(far):
            return self.blocks(s, s)
        self.inside(near)
        self.inside(far)
        self.across(near_edge, far_edge)

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """All close pairs between two sets."""
        if not len(a) or not len(b):
            return
        if min(len(a), len(b)) <= LEAF:
            return self.blocks(a, b)
        both = np.concatenate([a, b])
        vantage = self.points[b[0]]
        near, far, _, _ = self.split(both, vantage)
        if not len(far):
            return self.blocks(a, b)
        edge = int(np.bitwise_count(self.points[near] ^ vantage).max())
        da, db = (np.bitwise_count(self.points[s] ^ vantage).astype(int) for s in (a, b))
        self.across(a[da <= edge], b[db <= edge])
        self.across(a[da > edge], b[db > edge])
        self.blocks(a[(da <= edge) & (da > edge - MAX_BITS)], b[(db > edge) & (db <= edge + MAX_BITS)])
        self.blocks(a[(da > edge) & (da <= edge + MAX_BITS)], b[(db <= edge) & (db > edge - MAX_BITS)])

    def blocks(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 512):
            for j in range(0, len(b), 512):
                self.compare(a[i : i + 512], b[j : j + 512])


def shell_members(points: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Which fingerprints of one shell have a close one."""
    shell = Shell(points, home, None, 0)
    shell.inside(np.arange(len(points)))
    return shell.met


def shell_links(points: np.ndarray, home: np.ndarray, check: np.ndarray | None, check_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between positions of one shell."""
    shell = Shell(points, home, check, check_bits)
    shell.inside(np.arange(len(points)))
    moved = np.flatnonzero(shell.label != np.arange(len(points)))
    return moved, shell.label[moved]


def close_links(prints: DataFrame, checks: DataFrame | None = None, check_bits: int = 0) -> DataFrame:
    """Links `a, b` that connect all `id`s with `print`s that differ in at most 4 bits.

    Rows of `prints` are `id, print`; an id may have several prints.  With `checks` (one row per
    `id`, further words of bits in the other columns) a pair is linked only if these differ
    in at most `check_bits` bits altogether.  The links of a shell are a spanning forest, so a
    group of n close prints gives n - 1 of them.
    """
    check = [] if checks is None else [c for c in checks.columns if c != "id"]
    keys = prints.select("id", "print", F.explode(F.array(*band_keys(F.col("print")))).alias("key"))
    hubs = keys.groupBy("key").agg(F.min("print").alias("vantage"), F.count("*").alias("n")).filter("n > 1")
    shards = keys.join(hubs.drop("n"), "key")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("vantage")))
    shell = F.floor(distance / SHELL).cast("int")
    guest = (distance % SHELL < MAX_BITS) & (distance >= SHELL)
    shards = shards.withColumn("own", shell).withColumn("seats", F.when(guest, F.array("own", F.col("own") - 1)))
    shards = shards.withColumn("seat", F.explode(F.coalesce("seats", F.array("own"))))
    home = (F.col("seat") == F.col("own")).alias("home")
    seated = shards.select("key", "id", "print", F.col("seat").alias("shell"), home)
    ordered = seated.repartition("key", "shell").sortWithinPartitions("key", "shell")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a close one in their shell: few, so their checks are fetched afterwards."""
        for t in whole_groups(batches, ["key", "shell"]):
            points, home = t["print"].to_numpy().view(np.uint64), t["home"].to_numpy()
            group, small, starts, sizes = _sizes(t)
            met = np.zeros(len(points), bool)
            for step in range(1, 16):
                x = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
                x = x[(np.bitwise_count(points[x] ^ points[x + step]) <= MAX_BITS) & (home[x] | home[x + step])]
                met[x] = met[x + step] = True
            for start, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
                s = slice(start, start + size)
                met[s] = shell_members(points[s], home[s])
            yield from t.filter(pa.array(met)).to_batches()

    def _sizes(t: pa.Table) -> tuple[np.ndarray, ...]:
        starts = group_starts(t, ["key", "shell"])
        sizes = np.diff(np.append(starts, t.num_rows))
        return np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= 16, sizes), starts, sizes

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "shell"]):
            yield _links(t)

    def _links(t: pa.Table) -> pa.RecordBatch:
        group, small, starts, sizes = _sizes(t)
        ids, points = t["id"].to_numpy(), t["print"].to_numpy().view(np.uint64)
        home = t["home"].to_numpy()
        words = np.stack([t[c].to_numpy() for c in check], axis=1).view(np.uint64) if check else None
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, 16):
            x = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
            if not len(x):
                break
            y = x + step
            keep = (np.bitwise_count(points[x] ^ points[y]) <= MAX_BITS) & (home[x] | home[y])
            if words is not None:
                keep &= np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= check_bits
            a.append(x[keep])
            b.append(y[keep])
        for start, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
            s = slice(start, start + size)
            x, y = shell_links(points[s], home[s], None if words is None else words[s], check_bits)
            a.append(x + start)
            b.append(y + start)
        x, y = spanning_links(ids[np.concatenate(a)], ids[np.concatenate(b)])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    if checks is not None:
        met = ordered.mapInArrow(meet, ordered.schema).join(checks, "id")
        ordered = met.repartition("key", "shell").sortWithinPartitions("key", "shell")
    return ordered.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """`doc_id, fingerprint, component_id`: one row per input row.

    Fingerprints within 4 bits of each other are linked and `component_id` is the smallest
    `doc_id` that a chain of links reaches, the row's own included.  Null and wordless texts
    have fingerprint zero and link like any other.  A null `doc_id` never names a component
    unless the component has no other; repeated rows are kept.  An empty table gives no rows.
    Other columns are not read.
    """
    marked = with_fingerprint(docs.select("doc_id", "text"), "text", "fingerprint", words, seed)
    marked = cut_lineage(marked.select("doc_id", "fingerprint"))
    classes = cut_lineage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    prints = classes.select(F.col("fingerprint").alias("id"), F.col("fingerprint").alias("print"))
    roots = components(close_links(prints)).withColumnRenamed("node", "fingerprint")
    known = classes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(known.select("fingerprint", "root"), named, ["root"], "inner", ["fingerprint"])
    out = spread_join(marked, named, ["fingerprint"], "inner", ["doc_id"])
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


# How near copies are found: texts whose SimHash prints are linked by vantage points meet. The prints miss
# pairs near the least similarity, so keys of least hashes are the way for the rest: such a pair shares one
# but for a chance of (1 - 0.8 ** 5) ** 40, one in eight million. Shingles of five words decide.
COPY_KEYS = 40
KEY_ROWS = 5
SKETCH_WORDS = 8
SHINGLE = 5
BLOCK = 1024
SIMILARITY = 0.8


def min_hash_keys(shingles: np.ndarray) -> list[int]:
    """Keys of the least hashes of a set, `KEY_ROWS` in each; none of an empty set.  Signed."""
    if not len(shingles):
        return []
    factors = mixed(np.arange(1, COPY_KEYS * KEY_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (factors[:, None] * shingles[None, at : at + 256]).min(axis=1), out=least)
    rows = least.reshape(COPY_KEYS, KEY_ROWS)
    keys = np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64)
    return keys.view(np.int64).tolist()


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bits of how many shingles fall on each, odd or even: two sets differ in as many members as bits at least."""
    counts = np.bincount((mixed(shingles) >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def copy_prints(text: bytes) -> list[int]:
    """Two hashes of the set of shingles, its size, SimHash print and parities, then its keys."""
    shingles = np.unique(shingle_hashes(text, SHINGLE, 42))
    whole = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()
    return [*whole, len(shingles), fingerprint(shingles), *parities(shingles).tolist(), *min_hash_keys(shingles)]


def print_keys(prints: DataFrame) -> DataFrame:
    """`id, key` for rows `id, print`: ids have one key if a chain of prints within 4 bits joins theirs."""
    distinct = cut_lineage(prints.select("print").distinct())
    roots = components(close_links(distinct.select(F.col("print").alias("id"), "print"))).withColumnRenamed("node", "print")
    named = spread_join(prints, roots, ["print"], "left", ["id"])
    return named.select("id", F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("key"))


def similar_pairs(pairs: DataFrame, sketches: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs `a, b` of ids those whose sets of shingles have this Jaccard similarity at least.

    Sizes and parities (`id, size, bits`) only drop pairs that cannot have it; the rest is counted.
    """
    part, whole = Fraction(str(similarity)).as_integer_ratio()
    for end in ("a", "b"):
        own = sketches.select(F.col("id").alias(end), F.col("size").alias(f"size_{end}"), F.col("bits").alias(f"bits_{end}"))
        pairs = spread_join(pairs, own, [end], "inner", ["a", "b"], 4)
    apart = F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(apart, F.lit(0), lambda n, x: n + x)
    total = F.col("size_a") + F.col("size_b")
    pairs = pairs.filter(apart * (part + whole) <= total * (whole - part))
    pairs = pairs.filter(F.least("size_a", "size_b") * whole >= F.greatest("size_a", "size_b") * part).select("a", "b")
    few = cut_lineage(pairs)
    pairs = few.join(shingles.select(F.col("id").alias("a"), F.col("packed").alias("packed_a")), "a")
    hubs = shingles.join(few.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
    pairs = spread_join(pairs, hubs.select(F.col("id").alias("b"), F.col("packed").alias("packed_b")), ["b"], "inner", ["a"], 4)

    @F.arrow_udf(returnType="boolean")
    def similar(first: pa.Array, second: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(first, second, strict=True):
            x, y = unpack_sorted(x.as_py()), unpack_sorted(y.as_py())
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(shared * whole >= (len(x) + len(y) - shared) * part)
        return pa.array(out, pa.bool_())

    return pairs.filter(similar("packed_a", "packed_b")).select("a", "b")


def _star_pairs(seats: DataFrame, crowds: DataFrame) -> DataFrame:
    """Every id with the smallest and the largest of each of its keys."""
    hubs = crowds.select("key", "least", "most")
    near = spread_join(seats, hubs, ["key"], "inner", ["id"], 4)
    ends = F.when(F.col("id") == F.col("least"), F.array("most")).otherwise(F.array("least", "most"))
    return near.select(F.col("id").alias("x"), F.explode(ends).alias("y")).filter("x <> y")


class CopyTree:
    """Vantage-point search among sets of shingles, by their parities, for pairs that may be similar.

    Parities differ in no more bits than the sets do in members, and two sets at the least
    similarity differ in at most `size * (whole - part) / part` members, whichever of the two
    sizes is taken; so the triangle inequality drops only pairs that are not similar.
    """

    def __init__(self, label: np.ndarray, size: np.ndarray, bits: np.ndarray, part: int, whole: int):
        self.label, self.size, self.bits, self.part, self.whole = label, size, bits, part, whole
        self.reach = size * (whole - part) // part
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.compared = 0

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        """Of pairs of positions, those with different labels that may be similar."""
        size, part, whole = self.size, self.part, self.whole
        keep = (self.label[x] != self.label[y]) & (np.minimum(size[x], size[y]) * whole >= np.maximum(size[x], size[y]) * part)
        x, y = x[keep], y[keep]
        self.compared += len(x)
        apart = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(axis=1, dtype=np.int64)
        keep = apart * (part + whole) <= (size[x] + size[y]) * (whole - part)
        self.found.append((x[keep], y[keep], apart[keep]))

    def inside(self, s: np.ndarray) -> None:
        """All pairs of a set: those of the near and the far half, and those across the edge."""
        if len(s) <= LEAF:
            x, y = np.triu_indices(len(s), 1)
            return self.compare(s[x], s[y])
        d = self._distances(s, s[0])
        edge = np.sort(d)[(len(d) - 1) // 2]
        near = d <= edge
        if near.all():
            x = np.arange(len(s))
            for at in range(0, len(s), LEAF):
                i, j = np.meshgrid(x[at : at + LEAF], x[at:], indexing="ij")
                self.compare(s[i[i < j]], s[j[i < j]])
            return
        reach = self.reach[s]
        self.inside(s[near])
        self.inside(s[~near])
        self.across(s[near & (d + reach > edge)], s[~near & (d - reach <= edge)])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of a member of `a` with one of `b`."""
        if not len(a) or not len(b):
            return
        if min(len(a), len(b)) > LEAF:
            da, db = self._distances(a, b[0]), self._distances(b, b[0])
            edge = np.sort(np.concatenate([da, db]))[(len(a) + len(b) - 1) // 2]
            ra, rb = self.reach[a], self.reach[b]
            na, nb = da <= edge, db <= edge
            parts = [
                (a[na], b[nb]), (a[~na], b[~nb]),
                (a[na & (da + ra > edge)], b[~nb & (db - rb <= edge)]), (a[~na & (da - ra <= edge)], b[nb & (db + rb > edge)]),
            ]
            if sum(len(x) * len(y) for x, y in parts) < 0.9 * len(a) * len(b):
                for x, y in parts:
                    self.across(x, y)
                return
        for i in range(0, len(a), LEAF):
            for j in range(0, len(b), 8 * LEAF):
                x, y = np.meshgrid(a[i : i + LEAF], b[j : j + 8 * LEAF], indexing="ij")
                self.compare(x.ravel(), y.ravel())

    def _distances(self, s: np.ndarray, vantage: int) -> np.ndarray:
        return np.bitwise_count(self.bits[s] ^ self.bits[vantage]).sum(axis=1, dtype=np.int64)


def possible_pairs(t: pa.Table, part: int, whole: int) -> tuple[np.ndarray, ...]:
    """Positions of two rows of one place with different labels that may be similar, and in how many bits they differ.

    A place holds the ids of one block, or of two blocks (`low`, `high`) whose members meet each other.
    """
    keys = ["key", "low", "high"]
    starts = group_starts(t, keys)
    sizes = np.diff(np.append(starts, t.num_rows))
    group, small = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= 16, sizes)
    label, own, low, high = (t[c].to_numpy() for c in ("label", "own", "low", "high"))
    bits = pa.concat_arrays(t["bits"].chunks).flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)
    tree = CopyTree(label, t["size"].to_numpy(), bits, part, whole)
    for step in range(1, 16):
        x = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
        x = x[(low[x] == high[x]) | (own[x] != own[x + step])]
        tree.compare(x, x + step)
    for start, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        s = np.arange(start, start + n)
        if low[start] != high[start]:
            tree.across(s[own[s] == low[start]], s[own[s] == high[start]])
            continue
        names, counts = np.unique(label[s], return_counts=True)
        common = label[s] == names[counts.argmax()]
        tree.inside(s[~common])
        tree.across(s[~common], s[common])
    return tuple(np.concatenate(c) for c in zip(*tree.found, strict=True))


def _places(seats: DataFrame, crowds: DataFrame, part: int, whole: int) -> DataFrame:
    """The ids of each key dealt to places: `key, low, high, own`, with `id, label, size, bits`.

    A key of at most `BLOCK` ids is one place.  In a larger one the ids, those of its commonest
    label apart, are ordered by their distance to a vantage point (its smallest id) and cut into
    blocks, so that a block is a shell; two blocks are a place unless the triangle inequality
    or the sizes rule out that they hold a similar pair, or all their ids have the commonest label.
    """
    columns = ["id", "label", "size", "bits"]
    met = spread_join(seats, crowds.select("key", "n", "least"), ["key"], "inner", ["id"], 4)
    zeros = [F.lit(0).cast("long").alias(c) for c in ("low", "high", "own")]
    few = met.filter(F.col("n") <= BLOCK).select("key", *zeros, *columns)
    crowded = cut_lineage(met.filter(F.col("n") > BLOCK).drop("n"))
    vantage = crowded.filter("id = least").select("key", F.col("bits").alias("vantage"))
    common = crowded.groupBy("key", "label").agg(F.count("*").alias("n"))
    common = common.groupBy("key").agg(F.max(F.struct("n", "label")).alias("_m")).select("key", F.col("_m.label").alias("common"))
    apart = F.zip_with("bits", "vantage", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(apart, F.lit(0), lambda n, x: n + x)
    shells = spread_join(crowded, vantage.join(common, "key"), ["key"], "inner", ["id"], 4)
    side = (F.col("label") == F.col("common")).cast("long")
    shells = scan_number(shells.select("key", side.alias("side"), apart.alias("d"), *columns), ["key", "side"], ["d", "id"], "at")
    block = F.floor((F.col("at") - 1) / BLOCK) * 2 + F.col("side")
    shells = cut_lineage(shells.select("key", "d", block.alias("own"), *columns))
    blocks = cut_lineage(shells.groupBy("key", "own").agg(
        F.min("d").alias("near"), F.max("d").alias("far"), F.min("size").alias("least"), F.max("size").alias("most"),
    ))
    a = blocks.select("key", *[F.col(c).alias(f"a_{c}") for c in ("own", "near", "far", "least", "most")])
    b = blocks.select("key", *[F.col(c).alias(f"b_{c}") for c in ("own", "near", "far", "least", "most")])
    gap = F.greatest(F.col("a_near") - F.col("b_far"), F.col("b_near") - F.col("a_far"))
    pairs = a.join(b, "key").filter("a_own <= b_own AND (a_own % 2 = 0 OR b_own % 2 = 0)").filter(
        (gap * (part + whole) <= (F.col("a_most") + F.col("b_most")) * (whole - part))
        & (F.col("a_most") * whole >= F.col("b_least") * part)
        & (F.col("b_most") * whole >= F.col("a_least") * part)
    )
    pairs = pairs.select("key", F.col("a_own").alias("low"), F.col("b_own").alias("high"))
    seated = pairs.withColumn("own", F.explode(F.array_distinct(F.array("low", "high"))))
    many = shells.join(seated, ["key", "own"]).select("key", "low", "high", "own", *columns)
    return few.union(many)


def _block_pairs(seats: DataFrame, crowds: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs of ids of one key with different labels that may be similar: all, or for every id its nearest."""
    part, whole = Fraction(str(similarity)).as_integer_ratio()
    place = ["key", "low", "high"]
    met = _places(seats, crowds, part, whole).repartition(*place).sortWithinPartitions(*place)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, place):
            x, y, apart = possible_pairs(t, part, whole)
            if nearest:
                x, y, apart = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([apart, apart])
                order = np.lexsort((apart, x))
                x, y = x[order], y[order]
                first = np.diff(x, prepend=-1) > 0
                x, y = x[first], y[first]
            ids = t["id"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[x], pa.int64()), pa.array(ids[y], pa.int64())], ["x", "y"])

    return met.mapInArrow(pairs, "x long, y long")


def copy_roots(met: DataFrame, sketches: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """`node, root` of the groups connected by similar pairs among the ids that share a key.

    First every id is compared with two others of each of its keys, which joins nearly all of a
    group.  Only keys that still hold several groups are searched further, in shells around a
    vantage point and, inside these, by vantage-point trees: for every id the nearest of another
    group, then all pairs of different groups that are still open.
    Pairs of one group are never needed, so the result is that of comparing all.
    """
    links = tried = None
    roots = met.sparkSession.createDataFrame([], "node long, root long")
    for step in ("stars", "nearest", "all"):
        known = sketches.join(roots.withColumnRenamed("node", "id"), "id", "left")
        seats = met.join(known.withColumn("label", F.coalesce("root", "id")).drop("root"), "id")
        crowds = seats.groupBy("key").agg(
            F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"),
            F.min("label").alias("_low"), F.max("label").alias("_high"),
        )
        crowds = crowds.filter("_low <> _high")
        if step == "stars":
            pairs = _star_pairs(met, crowds)
        else:
            pairs = _block_pairs(seats, cut_lineage(crowds), similarity, step == "nearest")
        pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        pairs = cut_lineage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        found = cut_lineage(similar_pairs(pairs, sketches, shingles, similarity))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            roots = components(links)
    return roots


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, all columns, without near copies: of every group the smallest `doc_id` stays.

    A group is connected by pairs whose sets of five-word shingles have a Jaccard similarity of
    `similarity` at least, counted exactly; candidates are pairs whose SimHash prints are linked or
    that share a key of least hashes.  Equal texts are copies, null and wordless texts of each other too.  A null `doc_id` counts as larger than all; of rows that are equal in id
    and text one stays.  An empty table gives no rows.
    """
    @F.arrow_udf(returnType="array<long>")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([copy_prints(t or b"") for t in texts.to_pylist()], pa.list_(pa.int64()))

    text = F.coalesce("text", F.lit(""))
    key = [
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"),
        F.xxhash64(F.lit(1), text).alias("_t1"),
        F.xxhash64(F.lit(2), text).alias("_t2"),
    ]
    marked = cut_lineage(docs.select(*key, prints(F.col("text").cast("binary")).alias("prints")))
    sets = [F.col("prints")[i].alias(f"_s{i}") for i in range(2)]
    classes = marked.groupBy(*sets).agg(
        F.min(F.struct("_id", "_t1", "_t2")).alias("least"), F.any_value("prints").alias("prints")
    )
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    near = print_keys(classes.filter(F.col("prints")[2] > 0).select("id", F.col("prints")[3].alias("print")))
    own_keys = F.array_distinct(F.slice("prints", SKETCH_WORDS + 5, COPY_KEYS))
    keys = cut_lineage(near.unionByName(classes.select("id", F.explode(own_keys).alias("key"))))
    sketches = classes.select("id", F.col("prints")[2].alias("size"), F.slice("prints", 5, SKETCH_WORDS).alias("bits"))
    met = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut_lineage(keys.join(met, "key").select("id", "key"))
    texts = classes.join(met.select("id").distinct(), "id", "left_semi").select("id", "least.*")
    texts = docs.select(*key, "text").join(texts, ["_id", "_t1", "_t2"])

    @F.arrow_udf(returnType="binary")
    def packed(texts: pa.Array) -> pa.Array:
        found = (np.unique(shingle_hashes(t or b"", SHINGLE, 42)) for t in texts.to_pylist())
        return pa.array([pack_sorted(x) for x in found], pa.binary())

    shingles = texts.select("id", packed(F.col("text").cast("binary")).alias("packed"))
    shingles = cut_lineage(shingles.dropDuplicates(["id"]))
    roots = copy_roots(met, sketches, shingles, similarity).withColumnRenamed("node", "id")
    known = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = known.groupBy("root").agg(F.min("least").alias("first")).select("first.*")
    one = Window.partitionBy("_t1", "_t2", "_id").orderBy(F.lit(0))
    used = ["doc_id", "text"]
    rows = set_aside(docs, used).select("*", *key).join(first, ["_t1", "_t2", "_id"])
    return rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(*bring_back(docs.columns, used))
