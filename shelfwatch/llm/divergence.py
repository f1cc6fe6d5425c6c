"""How the sources of a language differ in their use of its vocabulary.

A language's vocabulary is the sorted list of terms that enough of its documents hold.  It is built into
minimal acyclic transducers of bounded size, one file each in the shared folder; texts are streamed
through them to be recounted, so what travels from then on are ordinals, and their order is the
terms' order, which settles ties.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import first_rows, number_rows
from ..session import cut_lineage, shared_path
from .files import new_file, open_random
from .transducer import Transducer

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
SCALE = 1_000_000_000
SHARD_TERMS = 1 << 15
CACHE_BYTES = 256 << 20
CHUNK_BYTES = 4 << 20
BLOCK_TERMS = 1024
TERM = re.compile(rb"[a-z\x80-\xff]+")
LETTER = np.array([97 <= b < 123 or b >= 128 for b in range(256)])
SHARD = "lang string, shard long, first string, base long, n_terms long, path string"
COUNTED = "lang string, source string, ordinal long, n long"
APART = "lang string, source string, item string, f long"


def document_counts(docs: DataFrame) -> DataFrame:
    """`lang, term, n_docs`: in how many rows of its language each term occurs, counted per batch before the exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[lang].update(set(TERM.findall(text.encode().lower())))
            rows = [(lang, term, n) for lang, terms in found.items() for term, n in terms.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            lang, term, n = map(list, columns)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(lang, pa.string()), "term": pa.array(term, pa.binary()).cast(pa.string()),
                "n_docs": pa.array(n, pa.int64()),
            })

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, term string, n_docs long")
    return counted.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))


def vocabularies(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`lang, term, ordinal`: the terms that at least `min_docs` rows of a language hold, numbered from 0 in byte order."""
    kept = document_counts(docs).filter(F.col("n_docs") >= min_docs).select("lang", "term")
    placed = number_rows(kept, [F.col("lang"), F.col("term")], "place")
    first = placed.groupBy("lang").agg(F.min("place").alias("first"))
    return placed.join(first, "lang").select("lang", "term", (F.col("place") - F.col("first")).alias("ordinal"))


def write_transducers(terms: DataFrame, folder: str, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One transducer file per `shard_terms` consecutive terms of a language, and a row that describes it."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("ordinal")
        words = group["term"].cast(pa.binary()).to_pylist()
        with new_file(folder, "terms", ".npz") as (path, out):
            out.write(Transducer.of(words).dumps())
        row = group.slice(0, 1)
        return pa.table({
            "lang": row["lang"], "shard": row["shard"], "first": row["term"], "base": row["ordinal"],
            "n_terms": pa.array([len(words)], pa.int64()), "path": pa.array([path], pa.string()),
        })

    sharded = terms.withColumn("shard", F.floor(F.col("ordinal") / shard_terms))
    return cut_lineage(sharded.groupBy("lang", "shard").applyInArrow(build, SHARD))


class Shelf:
    """The transducers of all languages, read when they are asked for; the last ones used stay in memory."""

    def __init__(self, shards: list[tuple[str, str, int, str]]):
        self._of = defaultdict(list)
        for lang, first, base, path in sorted(shards):
            self._of[lang].append((first.encode(), base, path))
        self._held: OrderedDict[str, Transducer] = OrderedDict()

    def _read(self, path: str) -> Transducer:
        if path not in self._held:
            with open_random(path) as file:
                self._held[path] = Transducer.loads(file.read())
        self._held.move_to_end(path)
        while len(self._held) > 1 and sum(t.target.nbytes * 2 for t in self._held.values()) > CACHE_BYTES:
            self._held.popitem(last=False)
        return self._held[path]

    def ordinals(self, lang: str, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The ordinal of each word in its language, -1 for others; a word visits the shards its first bytes allow."""
        out, shards = np.full(len(start), -1, np.int64), self._of.get(lang, [])
        words = leading(data, start, stop) if len(shards) > 1 else np.zeros(len(start), np.uint64)
        firsts = np.array([int.from_bytes(f[:8].ljust(8, b"\0"), "big") for f, _, _ in shards], np.uint64)
        for i, (_, base, path) in enumerate(shards):
            some = np.ones(len(start), bool)
            if i:
                some &= words >= firsts[i]
            if i + 1 < len(shards):
                some &= words <= firsts[i + 1]
            some = np.flatnonzero(some)
            if len(some):
                found = self._read(path).ordinals(data, start[some], stop[some])
                out[some[found >= 0]] = base + found[found >= 0]
        return out


def leading(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number that sorts like them."""
    code = np.zeros(len(start), np.uint64)
    for k in range(8):
        inside = start + k < stop
        code = code << np.uint64(8) | np.where(inside, data[np.where(inside, start + k, 0)], 0).astype(np.uint64)
    return code


def count_terms(shelf: Shelf, rows: list[tuple[str, str, bytes]]) -> Iterator[tuple[str, str, int, int]]:
    """`(lang, source, ordinal, n)` of a portion of texts; every group has a row with ordinal -1 as well."""
    by_lang = defaultdict(list)
    for lang, source, text in rows:
        by_lang[lang].append((source, text))
    for lang, texts in by_lang.items():
        sources = sorted({s for s, _ in texts})
        yield from ((lang, s, -1, 0) for s in sources)
        data = np.frombuffer(b"\n".join(t for _, t in texts).lower() + b"\n", np.uint8)
        edges = np.flatnonzero(np.diff(LETTER[data], prepend=False))
        start, stop = edges[::2], edges[1::2]
        ordinal = shelf.ordinals(lang, data, start, stop)
        ends = np.cumsum([len(t) + 1 for _, t in texts])
        group = np.searchsorted(sources, [s for s, _ in texts])[np.searchsorted(ends, start, side="right")]
        known = ordinal >= 0
        code, n = np.unique(group[known] << 40 | ordinal[known], return_counts=True)
        for c, k in zip(code.tolist(), n.tolist(), strict=True):
            yield lang, sources[c >> 40], c & (1 << 40) - 1, k


def recount(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """`lang, source, ordinal, n`: occurrences of the kept terms; a row with ordinal -1 for every group of `docs`.

    The list of shards has one row per language and `SHARD_TERMS` terms.
    """
    listed = [tuple(r) for r in shards.select("lang", "first", "base", "path").collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf(listed)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            texts = [t.encode() for t in columns[2]]
            at = np.cumsum([len(t) for t in texts]) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)] if texts else [0]
            for a, b in zip(cuts, cuts[1:]):
                rows = list(count_terms(shelf, list(zip(columns[0][a:b], columns[1][a:b], texts[a:b], strict=True))))
                names = ("lang", "source", "ordinal", "n")
                types = (pa.string(), pa.string(), pa.int64(), pa.int64())
                found = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(found, types, strict=True)], names)

    counted = docs.select("lang", "source", "text").mapInArrow(count, COUNTED)
    return counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exactly; 1 without terms."""
    whole = "decimal(38,0)"
    part = (F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")).cast(whole)
    of = (total + SMOOTHING * n_terms).cast(whole)
    # The remainder first, so that the division has no fraction to round.
    return F.when(of > 0, ((part - part % of) / of).cast("long") + 1).otherwise(F.lit(1).cast("long"))


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """`lang, source, item, f`: the summed differences of every pair of sources of a language, both ways.

    `shares(lang, source, ordinal, p)` has the terms a group holds, `groups(lang, source, n_terms, p0)` the
    share of those it lacks.  A task sees `BLOCK_TERMS` terms of all sources of a language.
    """
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_terms") - 1) / BLOCK_TERMS)))
    absent = groups.filter("n_terms > 0").select("lang", "source", "n_terms", "p0", blocks.alias("block"))
    present = shares.withColumn("block", F.floor(F.col("ordinal") / BLOCK_TERMS))

    def compare(present: pa.Table, absent: pa.Table) -> pa.Table:
        absent = absent.sort_by("source")
        sources = absent["source"].to_pylist()
        first = absent["block"][0].as_py() * BLOCK_TERMS
        p = np.repeat(absent["p0"].to_numpy()[:, None], min(BLOCK_TERMS, absent["n_terms"][0].as_py() - first), axis=1)
        row = {s: i for i, s in enumerate(sources)}
        at = [row[s] for s in present["source"].to_pylist()]
        p[at, present["ordinal"].to_numpy() - first] = present["p"].to_numpy()
        n = len(sources)
        a, b = np.triu_indices(n, 1)
        f = [np.abs(p[i + 1 :] - p[i]).sum(axis=1) for i in range(n)]
        names = np.array(sources, object)
        lang = [absent["lang"][0].as_py()] * len(a)
        return pa.table({
            "lang": pa.array(lang, pa.string()), "source": pa.array(names[a], pa.string()),
            "item": pa.array(names[b], pa.string()), "f": pa.array(np.concatenate(f).astype(np.int64), pa.int64()),
        })

    keys = ["lang", "block"]
    halves = present.groupBy(*keys).cogroup(absent.groupBy(*keys)).applyInArrow(compare, APART)
    sums = halves.groupBy("lang", "source", "item").agg(F.sum("f").alias("f"))
    return sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "f"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """`lang, source, part, item, value, rank` for every source of every language.

    Part `pair` ranks the other sources of the language by the summed differences of their shares of
    the kept terms; part `term` has the `top` terms a source uses more than its language does.  Terms
    are runs of letters of `text` (A-Z as a-z, and everything beyond ASCII).  Null texts, languages and
    sources are empty strings; repeated rows count as often as they occur; a language without kept terms
    has pairs of value 0; other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = cut_lineage(vocabularies(docs, min_docs))
    shards = write_transducers(terms, shared_path(docs.sparkSession, "transducers"), shard_terms)
    counts = cut_lineage(recount(docs, shards))

    n_terms = shards.groupBy("lang").agg(F.sum("n_terms").alias("n_terms"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(n_terms, "lang", "left")
    groups = groups.select("lang", "source", "total", F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"))
    of = F.col("total"), F.col("n_terms")
    groups = cut_lineage(groups.withColumn("p0", share(F.lit(0), *of)))
    in_group = counts.filter("n > 0").join(groups, ["lang", "source"])
    shares = in_group.select("lang", "source", "ordinal", share(F.col("n"), *of).alias("p"))

    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").filter("source <> item")
    pairs = pairs.join(pair_distances(shares, groups), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", "item", F.coalesce("f", F.lit(0).cast("long")).alias("value"))
    ranked = first_rows(pairs, ["lang", "source"], [F.col("value").desc(), "item"], (1 << 31) - 1, "rank")

    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("n_terms").alias("n_terms"))
    overall = counts.filter("n > 0").groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    overall = overall.join(langs, "lang").select("lang", "ordinal", share(F.col("n"), *of).alias("q"))
    above = shares.join(overall, ["lang", "ordinal"]).filter("p > q")
    above = above.select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    best = first_rows(above, ["lang", "source"], [F.col("value").desc(), "ordinal"], top, "rank")
    named = best.join(terms, ["lang", "ordinal"]).withColumnRenamed("term", "item")

    shown = [F.col(c) for c in ("item", "value", "rank")]
    return ranked.select("lang", "source", F.lit("pair").alias("part"), *shown).union(
        named.select("lang", "source", F.lit("term").alias("part"), *shown)
    )
