"""The entity registry.

Candidates have the columns `feed_ord, pos, domain, url, name, clean_name`; they are
taken in the order (feed_ord, pos, url).  For each one, in that order:

* the entity is created when its clean name is unknown (new);
* otherwise it is on a new platform when no source holds (entity, domain) (cross);
* a source is added unless its URL or its (entity, domain) is taken; only then are
  the entity's count and score refreshed.

All of this stays within a clean name, so candidates and what the registry knows of
their names are dealt by clean name and read once in that order (`_decide`): the texts
are moved once.  A name with more rows than one task should hold is decided by sets
(`_decide_large`): the first candidate of a clean name decides "new", the accepted
candidate of a (clean name, domain) ends the reports of that pair.  Unless a URL is
listed under two domains, that is the first candidate of the pair and aggregates
with map-side combine find it.  Pairs that hold such a shared URL compete for it;
they are resolved separately and exactly by `settle`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import score
from ..functions.text import entity_id, timestamp
from ..session import cut_lineage, shared_path
from .ranking import first_per, scan_number, scan_totals, spread_join

ORDER = ["feed_ord", "pos", "url"]
BLOCK = 65536
CANDIDATE = [*ORDER, "domain", "name", "clean_name"]
# Rows of a clean name in the order in which `_in_order` reads them.
KNOWN, HELD, TAKEN, LISTED = range(4)


class UpsertResult(NamedTuple):
    changes: DataFrame
    games: DataFrame
    sources: DataFrame
    new_sources: DataFrame
    changed_games: DataFrame


class Touched(NamedTuple):
    """What the registry knows about the candidates."""

    known: DataFrame
    pairs: DataFrame
    urls: DataFrame


def platform_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("game_id").agg(F.countDistinct("domain").cast("int").alias("platform_count"))


def refresh_stats(games: DataFrame, sources: DataFrame, as_of, touched: DataFrame | None = None) -> DataFrame:
    """Count and score from the sources, for all games or for `touched(id)` only."""
    counts = platform_counts(sources).select(F.col("game_id").alias("id"), F.col("platform_count").alias("_n"))
    joined = games.join(counts, "id", "left")
    if touched is not None:
        joined = joined.join(touched.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
        due = F.coalesce("_t", F.lit(False))
    else:
        due = F.lit(True)
    n = F.coalesce("_n", F.lit(0))
    new = {"platform_count": n, "score": score(n), "updated_at": timestamp(as_of)}
    return joined.select(
        *[F.when(due, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in games.columns]
    )


def lookup_games(candidates: DataFrame, games: DataFrame) -> DataFrame:
    """Adds `game_id`, NULL when the clean name is unknown."""
    return candidates.join(games.select("clean_name", F.col("id").alias("game_id")), "clean_name", "left")


def missing_platforms(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates (with `game_id`) whose (game, domain) no source holds."""
    held = sources.select("game_id", "domain").distinct()
    return candidates.join(held, ["game_id", "domain"], "left_anti").select(*candidates.columns)


def insert_games(candidates: DataFrame, games: DataFrame, as_of) -> DataFrame:
    """The games to add: the first name of every unknown clean name, with default count and score."""
    firsts = first_per(candidates.select("clean_name", *ORDER, "name"), ["clean_name"], ORDER)
    fresh = firsts.join(games.select("clean_name"), "clean_name", "left_anti")
    return fresh.select(
        entity_id(F.col("clean_name")).alias("id"),
        "name",
        "clean_name",
        F.lit(1).alias("platform_count"),
        F.lit(1.0).cast("float").alias("score"),
        timestamp(as_of).alias("first_seen"),
        timestamp(as_of).alias("updated_at"),
    )


def _touched(candidates: DataFrame, games: DataFrame, sources: DataFrame) -> Touched:
    """The part of the registry that the candidates can meet: each table is read once per
    join key, and all further steps work on frames of the size of the candidates."""
    names = candidates.select("clean_name").distinct()
    known = games.select("clean_name", F.col("id").alias("game_id"), F.col("platform_count").alias("stored"))
    known = cut_lineage(known.join(names, "clean_name", "left_semi"))
    pairs = sources.join(known.select("game_id", "clean_name"), "game_id").select("clean_name", "domain").distinct()
    return Touched(known, cut_lineage(pairs), sources.select("url"))


def _decide(candidates: DataFrame, touched: Touched) -> DataFrame:
    """The candidates to report with `is_new`, `platform_count` (NULL for a new entity) and whether their source is `added`."""
    taken = candidates.select("clean_name", "url").join(touched.urls, "url", "left_semi").distinct()
    known = touched.known.select("clean_name", F.coalesce("stored", F.lit(1)).cast("long").alias("_stored"))
    rows = candidates.withColumn("_kind", F.lit(LISTED)).withColumn("_stored", F.lit(None).cast("long"))
    for kind, marks in ((KNOWN, known), (HELD, touched.pairs), (TAKEN, cut_lineage(taken))):
        rows = rows.unionByName(marks.withColumn("_kind", F.lit(kind)), allowMissingColumns=True)
    n = rows.count()
    large = _large_names(rows, n)
    if large is None:
        return cut_lineage(_in_order(rows, n))
    small = spread_join(rows, large, ["clean_name"], "left_anti", ["domain", "url"]).select(*rows.columns)
    rest = spread_join(candidates, large, ["clean_name"], "left_semi", ["domain", "url"]).select(*CANDIDATE)
    return cut_lineage(_in_order(small, n).unionByName(_decide_large(cut_lineage(rest), touched)))


def _large_names(rows: DataFrame, n: int) -> DataFrame | None:
    """Clean names with more than a block of the `n` rows, if there are any.

    Rows are counted by a hash of their name in slots of a quarter of a block on average, so only names in a slot
    that is full are counted themselves.
    """
    if n <= BLOCK:
        return None
    slots = rows.select("clean_name", F.pmod(F.xxhash64("clean_name"), F.lit(n // max(1, BLOCK // 4) + 1)).alias("_slot"))
    full = slots.groupBy("_slot").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
    full = cut_lineage(full.select("_slot"))
    if full.isEmpty():
        return None
    names = slots.join(full, "_slot", "left_semi").groupBy("clean_name").agg(F.count("*").alias("_n"))
    large = cut_lineage(names.filter(F.col("_n") > BLOCK).select("clean_name"))
    return None if large.isEmpty() else large


def _in_order(rows: DataFrame, n: int) -> DataFrame:
    """`_decide` for names that one task can hold; the domains and URLs of the name at hand are held."""
    fields = [rows.schema[c] for c in CANDIDATE]
    fields += [T.StructField("is_new", T.BooleanType()), T.StructField("platform_count", T.LongType()), T.StructField("added", T.BooleanType())]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count, domains, urls = object(), None, set(), set()
        for batch in batches:
            kept, counts, added = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("clean_name", "_kind", "domain", "url", "_stored"))
            for i, (name, kind, domain, url, stored) in enumerate(zip(*columns, strict=True)):
                if name != current:
                    current, count, domains, urls = name, None, set(), set()
                if kind == KNOWN:
                    count = stored
                elif kind == HELD:
                    domains.add(domain)
                elif kind == TAKEN:
                    urls.add(url)
                elif domain not in domains:
                    kept.append(i)
                    counts.append(count)
                    added.append(url not in urls)
                    if added[-1]:
                        domains.add(domain)
                        urls.add(url)
                        count = len(domains)
                    elif count is None:
                        count = 1
            listed, before = batch.take(pa.array(kept, pa.int64())), pa.array(counts, pa.int64())
            decided = [before.is_null(), before, pa.array(added, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(listed.column(c) for c in CANDIDATE), *decided], names=[f.name for f in fields])

    dealt = rows.repartition(n // BLOCK + 1, "clean_name")
    ordered = dealt.sortWithinPartitions("clean_name", "_kind", *ORDER, "domain", "name")
    return ordered.mapInArrow(decide, T.StructType(fields))


def _decide_large(candidates: DataFrame, touched: Touched) -> DataFrame:
    """`_decide` for names that one task cannot hold."""
    accepted, dirty = _accept(candidates, touched)
    accepted = cut_lineage(accepted.select(*CANDIDATE).withColumn("added", F.lit(1)))
    # The first report of an unknown clean name creates the entity.
    rows = accepted if dirty is None else accepted.unionByName(_contested_reports(candidates, dirty, accepted))
    counted = scan_totals(
        rows, ["clean_name"], [*ORDER, "domain"], {"_sum": F.col("added"), "_rank": F.lit(1)}
    ).join(_with_held(touched), "clean_name", "left")
    is_new = F.col("game_id").isNull() & (F.col("_rank") == 1)
    before = F.col("_sum") - F.col("added")
    current = F.when(before == 0, F.coalesce("stored", F.lit(1))).otherwise(F.coalesce("held", F.lit(0)) + before)
    return counted.select(
        *CANDIDATE,
        is_new.alias("is_new"),
        F.when(~is_new, current.cast("bigint")).alias("platform_count"),
        (F.col("added") == 1).alias("added"),
    )


def _with_held(touched: Touched) -> DataFrame:
    """The known names with the number of domains that hold them."""
    held = touched.pairs.groupBy("clean_name").agg(F.count("*").alias("held"))
    return touched.known.join(held, "clean_name", "left").withColumn("held", F.coalesce("held", F.lit(0)))


def _accept(candidates: DataFrame, touched: Touched) -> tuple[DataFrame, DataFrame | None]:
    """`(accepted, dirty)`: the candidates whose source is added, and the (clean_name, domain)
    pairs that compete for a URL, if there are any."""
    edges = candidates.groupBy("clean_name", "domain", "url").agg(
        F.min(F.struct("feed_ord", "pos", "name")).alias("f")
    )
    edges = edges.join(touched.pairs, ["clean_name", "domain"], "left_anti").select(
        "clean_name", "domain", "url", "f.feed_ord", "f.pos", "f.name"
    )
    # URLs listed by several sites or held by the registry: few, so the join with them is cheap.
    listed = edges.select("url", F.lit(1).alias("n"), F.lit(False).alias("held"))
    held = touched.urls.select("url", F.lit(0).alias("n"), F.lit(True).alias("held"))
    contested = listed.unionByName(held).groupBy("url").agg(F.sum("n").alias("n"), F.max("held").alias("taken"))
    contested = contested.filter("n > 1 or n > 0 and taken").select("url", "taken")
    marked = edges.join(contested, "url", "left").select(
        *edges.columns, F.coalesce("taken", F.lit(False)).alias("taken"), F.col("taken").isNotNull().alias("shared")
    )
    marked = cut_lineage(marked)
    pairs = marked.groupBy("clean_name", "domain").agg(
        F.max("shared").alias("dirty"), F.min(F.struct(*ORDER, "name")).alias("f")
    )
    clean = pairs.filter("not dirty").select("clean_name", "domain", "f.*")
    dirty = pairs.filter("dirty").select("clean_name", "domain")
    if marked.filter("shared").isEmpty():
        return clean, None
    open_edges = marked.filter("not taken").join(dirty, ["clean_name", "domain"], "left_semi")
    settled = settle(open_edges.select("clean_name", "domain", *ORDER, "name"))
    return clean.unionByName(settled), dirty


def settle(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """First-come choice where each domain and each URL of a clean name is used once.

    A clean name with at most `block` edges is settled at once in one task.  The edges of a larger one are
    numbered in order and cut into blocks.  A round settles the first blocks that have about `block` edges
    left, which one task can hold, and then strikes out, over all tasks, every edge whose domain or URL has
    just been taken.  What a block leaves behind is thus small, and the next round starts at the first edge
    that is still open.
    """
    large = cut_lineage(edges.groupBy("clean_name").agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select("clean_name"))
    if large.isEmpty():
        return _greedy(edges)
    small = edges.join(large, "clean_name", "left_anti").select(*edges.columns)
    rows = spread_join(edges, large, ["clean_name"], "left_semi", ["url"]).select(*edges.columns)
    return _greedy(small).unionByName(_settle_in_rounds(rows, block))


def _settle_in_rounds(edges: DataFrame, block: int) -> DataFrame:
    """`settle` for the clean names that one task cannot hold."""
    numbered = scan_number(edges, ["clean_name"], [*ORDER, "domain", "name"], "_n")
    rest = cut_lineage(numbered.select(*edges.columns, F.floor((F.col("_n") - 1) / block).alias("_block")))
    path, rounds = shared_path(edges.sparkSession, "settled"), 0
    before = Window.partitionBy("clean_name").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        counts = rest.groupBy("clean_name", "_block").agg(F.count("*").alias("_open"))
        due = counts.withColumn("_before", F.coalesce(F.sum("_open").over(before), F.lit(0))).filter(F.col("_before") < block)
        due = cut_lineage(due.select("clean_name", "_block"))
        now = spread_join(rest, due, ["clean_name", "_block"], "left_semi", ["url"])
        _greedy(now.select(*edges.columns)).write.parquet(f"{path}/round={rounds}")
        rounds += 1
        won = edges.sparkSession.read.schema(edges.schema).parquet(f"{path}/round={rounds - 1}")
        rest = spread_join(rest, due, ["clean_name", "_block"], "left_anti", ["url"])
        rest = rest.join(won.select("clean_name", "url"), ["clean_name", "url"], "left_anti")
        # The planner takes the repeated rows for as few as there were before, so they are never sent to all tasks.
        taken = won.select("clean_name", "domain").hint("merge")
        rest = cut_lineage(spread_join(rest, taken, ["clean_name", "domain"], "left_anti", ["url"]))
        if rest.isEmpty():
            return edges.sparkSession.read.schema(edges.schema).parquet(*[f"{path}/round={i}" for i in range(rounds)])


def _greedy(edges: DataFrame) -> DataFrame:
    """The choice among the edges of one round, read once in order; the domains and URLs taken so far are held."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, domains, urls = None, set(), set()
        for batch in batches:
            kept = []
            columns = (batch.column(c).to_pylist() for c in ("clean_name", "domain", "url"))
            for i, (name, domain, url) in enumerate(zip(*columns, strict=True)):
                if name != current:
                    current, domains, urls = name, set(), set()
                if domain not in domains and url not in urls:
                    domains.add(domain)
                    urls.add(url)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    ordered = edges.repartition("clean_name").sortWithinPartitions("clean_name", *ORDER, "domain", "name")
    return ordered.mapInArrow(take, edges.schema)


def insert_sources(candidates: DataFrame, games: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """The source rows to add, under both uniqueness rules."""
    candidates = cut_lineage(candidates.select(*CANDIDATE))
    touched = _touched(candidates, games, sources)
    return _source_rows(_decide(candidates, touched).filter("added"), touched.known, as_of)


def _source_rows(accepted: DataFrame, known: DataFrame, as_of) -> DataFrame:
    ids = accepted.join(known.select("clean_name", "game_id"), "clean_name", "left")
    return ids.select(
        entity_id(F.col("url")).alias("id"),
        F.coalesce("game_id", entity_id(F.col("clean_name"))).alias("game_id"),
        "domain",
        "url",
        timestamp(as_of).alias("first_seen"),
    )


def _contested_reports(candidates: DataFrame, dirty: DataFrame, accepted: DataFrame) -> DataFrame:
    """Competing pairs report each candidate before their accepted one, or all when none is."""
    end = accepted.select("clean_name", "domain", F.struct(*ORDER).alias("_end"))
    return (
        candidates.join(dirty, ["clean_name", "domain"], "left_semi")
        .join(end, ["clean_name", "domain"], "left")
        .filter(F.col("_end").isNull() | (F.struct(*ORDER) < F.col("_end")))
        .select(*CANDIDATE)
        .withColumn("added", F.lit(0))
    )


def upsert_entities(candidates: DataFrame, games: DataFrame, sources: DataFrame, as_of) -> UpsertResult:
    """Changes to report and the next registry.

    `changes(feed_ord, pos, domain, url, name, clean_name, is_new, is_cross, platform_count)`:
    the count of a cross row is the one before its own refresh, NULL for a new entity.
    `new_sources` and `changed_games` are the rows by which the next registry differs.
    """
    candidates = cut_lineage(candidates.select(*CANDIDATE))
    touched = _touched(candidates, games, sources)
    decided = _decide(candidates, touched)
    accepted, known = decided.filter("added"), _with_held(touched)
    changes = decided.select(*CANDIDATE, "is_new", (~F.col("is_new")).alias("is_cross"), "platform_count")

    new_sources = _source_rows(accepted, touched.known, as_of)
    gained = accepted.groupBy("clean_name").agg(F.count("*").alias("gained"))
    totals = gained.join(known.select("clean_name", "held"), "clean_name", "left").select(
        "clean_name", (F.col("gained") + F.coalesce("held", F.lit(0))).cast("int").alias("_total")
    )
    fresh = insert_games(candidates, touched.known, as_of).select(*games.columns)
    grown = games.join(totals.select("clean_name"), "clean_name", "left_semi").select(*games.columns)
    merged = fresh.unionByName(grown).join(totals, "clean_name", "left")
    n = F.col("_total")
    refreshed = {"platform_count": n, "score": score(n), "updated_at": timestamp(as_of)}
    changed = merged.select(
        *[F.when(n.isNotNull(), refreshed[c]).otherwise(F.col(c)).alias(c) if c in refreshed else c for c in games.columns]
    )
    games2 = games.join(totals.select("clean_name"), "clean_name", "left_anti").select(*games.columns).unionByName(changed)
    sources2 = sources.unionByName(new_sources.select(*sources.columns))
    return UpsertResult(changes, games2, sources2, new_sources, changed)


def all_changes(new: DataFrame, cross: DataFrame) -> DataFrame:
    """Bag union; `part` sorts the new entities before the cross-platform ones."""
    return new.withColumn("part", F.lit(0)).unionByName(cross.withColumn("part", F.lit(1)))


def log_rows(changes: DataFrame, as_of) -> DataFrame:
    """One log row per check, that is per feed, with changes."""
    at = timestamp(as_of)
    counts = changes.groupBy("domain", "feed_ord").agg(F.count("*").alias("new_games_count"))
    return counts.select(log_id(at).alias("id"), "domain", "feed_ord", "new_games_count", at.alias("checked_at"))


def log_items(changes: DataFrame, as_of) -> DataFrame:
    """The entities of the log rows, one row each."""
    return changes.select(
        log_id(timestamp(as_of)).alias("log_id"),
        "feed_ord",
        "pos",
        "name",
        "url",
        "is_cross",
        "platform_count",
    )


def log_id(at: Column) -> Column:
    return entity_id(F.col("domain"), F.col("feed_ord").cast("string"), F.date_format(at, "yyyyMMddHHmmssSSS"))
