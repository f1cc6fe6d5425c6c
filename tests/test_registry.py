import random

import pytest

from shelfwatch.functions.text import entity_id
from shelfwatch.operators import registry
from shelfwatch.schemas import GAME_SOURCES, GAMES
from shelfwatch.workloads import fixtures as fx
from pyspark.sql import functions as F

AT = "2024-05-01 00:00:00"
CANDIDATES = "feed_ord bigint, pos bigint, domain string, url string, name string, clean_name string"


def sequential(candidates, games, sources):
    """One candidate after the other; games: name -> stored count, sources: set of (name, domain, url)."""
    games, sources, reports = dict(games), set(sources), []
    for feed, pos, domain, url, name, clean in sorted(candidates, key=lambda c: (c[0], c[1], c[3])):
        known = clean in games
        on_site = any(s[0] == clean and s[1] == domain for s in sources)
        if not known:
            games[clean] = 1
            reports.append((feed, pos, url, True, None))
        elif not on_site:
            reports.append((feed, pos, url, False, games[clean]))
        if not on_site and all(s[2] != url for s in sources):
            sources.add((clean, domain, url))
            games[clean] = len({s[1] for s in sources if s[0] == clean})
    return sorted(reports, key=str), games, sources


def frames(spark, games, sources):
    g = spark.createDataFrame([(n, c) for n, c in games.items()], "clean_name string, platform_count int").select(
        entity_id(F.col("clean_name")).alias("id"), F.col("clean_name").alias("name"), "clean_name", "platform_count",
        F.lit(1.0).cast("float").alias("score"), F.lit(AT).cast("timestamp").alias("first_seen"),
        F.lit(AT).cast("timestamp").alias("updated_at"),
    )
    s = spark.createDataFrame(list(sources), "clean_name string, domain string, url string").select(
        entity_id(F.col("url")).alias("id"), entity_id(F.col("clean_name")).alias("game_id"), "domain", "url",
        F.lit(AT).cast("timestamp").alias("first_seen"),
    )
    return g, s


def make(seed, shared):
    rnd = random.Random(seed)
    candidates = []
    for feed in range(12):
        domain = f"d{feed // 2}"
        for pos in range(rnd.randint(0, 12)):
            clean = f"g{rnd.randint(0, 6)}"
            site = f"s{rnd.randint(0, 3)}" if shared else domain
            candidates.append((feed, pos, domain, f"https://{site}/games/{clean}/{rnd.randint(0, 1)}", clean.upper(), clean))
    games = {f"g{i}": rnd.randint(1, 4) for i in range(3)}
    sources = set()
    for g in games:
        for d in rnd.sample(range(6), rnd.randint(0, 3)):
            url = f"https://s{d % 4}/games/{g}/0" if shared else f"https://d{d}/games/{g}/0"
            if all(s[2] != url for s in sources):
                sources.add((g, f"d{d}", url))
    return candidates, games, sources


@pytest.mark.parametrize("seed, shared", [(1, False), (2, True), (3, True), (4, True)])
def test_upsert_is_sequential(spark, seed, shared):
    candidates, games, sources = make(seed, shared)
    g, s = frames(spark, games, sources)
    up = registry.upsert_entities(spark.createDataFrame(candidates, CANDIDATES), g, s, AT)
    reports, games2, sources2 = sequential(candidates, games, sources)
    got = [(r.feed_ord, r.pos, r.url, r.is_new, r.platform_count) for r in up.changes.collect()]
    assert sorted(got, key=str) == reports
    assert {r.clean_name: r.platform_count for r in up.games.collect()} == games2
    names = {r.id: r.clean_name for r in up.games.collect()}
    assert {(names[r.game_id], r.domain, r.url) for r in up.sources.collect()} == sources2
    assert all(r.is_cross != r.is_new for r in up.changes.collect())


@pytest.mark.parametrize("seed, block", [(1, 5), (2, 5), (3, 10), (4, 1)])
def test_large_names_are_decided_by_sets(spark, monkeypatch, seed, block):
    """Names with more than a block of rows beside smaller ones: the result is the sequential one."""
    candidates, games, sources = make(seed, seed > 1)
    g, s = frames(spark, games, sources)
    large = []
    monkeypatch.setattr(registry, "BLOCK", block)
    monkeypatch.setattr(registry, "_decide_large", lambda c, t, f=registry._decide_large: large.append(c) or f(c, t))
    df = spark.createDataFrame(candidates, CANDIDATES)
    up = registry.upsert_entities(df, g, s, AT)
    reports, games2, sources2 = sequential(candidates, games, sources)
    got = [(r.feed_ord, r.pos, r.url, r.is_new, r.platform_count) for r in up.changes.collect()]
    assert sorted(got, key=str) == reports
    assert {r.clean_name: r.platform_count for r in up.games.collect()} == games2
    added = {(r.domain, r.url) for r in registry.insert_sources(df, g, s, AT).collect()}
    assert added == {x[1:] for x in sources2 - sources}
    names = [c[5] for c in candidates]
    assert {r.clean_name for r in large[0].collect()} >= {n for n in names if names.count(n) > block} and len(large) == 2


def test_registry_rows_decide_before_candidates(spark):
    """A known entity without sources, one held by the site, a URL that another entity's source holds."""
    games, sources = {"a": 3, "b": 2, "z": 1}, {("b", "d1", "https://d1/b"), ("z", "d9", "https://d1/c")}
    rows = [(1, 0, "d1", "https://d1/a", "A", "a"), (2, 0, "d2", "https://d2/a", "A", "a"), (1, 1, "d1", "https://d1/b2", "B", "b")]
    rows += [(1, 2, "d1", "https://d1/c", "C", "c"), (1, 3, "d1", "https://d1/c", "C", "c"), (3, 0, "d3", "https://d3/c", "C", "c")]
    g, s = frames(spark, games, sources)
    up = registry.upsert_entities(spark.createDataFrame(rows, CANDIDATES), g, s, AT)
    got = sorted((r.clean_name, r.feed_ord, r.pos, r.is_new, r.platform_count) for r in up.changes.collect())
    assert [x[:3] + (x[4],) for x in got] == [("a", 1, 0, 3), ("a", 2, 0, 1), ("c", 1, 2, None), ("c", 1, 3, 1), ("c", 3, 0, 1)]
    assert [x[3] for x in got] == [False, False, True, False, False]
    assert {(r.domain, r.url) for r in up.new_sources.collect()} == {("d1", "https://d1/a"), ("d2", "https://d2/a"), ("d3", "https://d3/c")}


def test_second_run_adds_nothing(spark):
    candidates, games, sources = make(5, False)
    df = spark.createDataFrame(candidates, CANDIDATES)
    g, s = frames(spark, games, sources)
    first = registry.upsert_entities(df, g, s, AT)
    second = registry.upsert_entities(df, first.games, first.sources, AT)
    assert second.changes.isEmpty() and second.new_sources.isEmpty()
    assert second.games.count() == first.games.count()


def test_new_games_have_the_name_of_the_first_url(spark):
    rows = [(1, 0, "d1", "https://d1/b", "B-x", "b-x"), (0, 5, "d0", "https://d0/b", "b_X", "b-x")]
    g, s = (spark.createDataFrame([], x) for x in (GAMES, GAME_SOURCES))
    fresh = registry.insert_games(spark.createDataFrame(rows, CANDIDATES), g, AT).first()
    assert (fresh.name, fresh.platform_count, fresh.score) == ("b_X", 1, 1.0)


def test_scores(spark):
    ns = spark.createDataFrame([(n,) for n in range(7)], "n int").orderBy("n")
    assert [r[0] for r in ns.select(registry.score(F.col("n"))).collect()] == [0.5, 1.0, 1.5, 2.0, 2.5, 2.5, 2.5]


def test_refresh_of_touched_games_only(spark):
    games, sources = {"a": 9, "b": 9}, {("a", "d1", "u1"), ("a", "d2", "u2")}
    g, s = frames(spark, games, sources)
    touched = spark.createDataFrame([("a",)], "clean_name string").select(entity_id(F.col("clean_name")).alias("id"))
    got = {r.clean_name: r.platform_count for r in registry.refresh_stats(g, s, AT, touched).collect()}
    assert got == {"a": 2, "b": 9}


def test_logs(spark):
    changes = spark.createDataFrame(
        [(0, 0, "d", "u1", "A", True, False, None), (0, 1, "d", "u2", "B", False, True, 3)],
        "feed_ord bigint, pos bigint, domain string, url string, name string, is_new boolean, is_cross boolean, platform_count bigint",
    )
    changes = changes.union(changes.withColumn("feed_ord", F.lit(1).cast("bigint")).filter("pos = 0"))
    log = registry.log_rows(changes, AT).orderBy("feed_ord").collect()
    items = registry.log_items(changes, AT).collect()
    assert [(r.domain, r.feed_ord, r.new_games_count) for r in log] == [("d", 0, 2), ("d", 1, 1)]
    assert {(r.log_id, r.feed_ord) for r in items} == {(r.id, r.feed_ord) for r in log} and len(items) == 3


def test_mirrors_are_settled_in_one_pass(spark):
    """Every site lists the same URLs in the same order: site i gets the i-th one that is left."""
    n = 30
    edges = [("x", f"d{i:02}", f"u{j:02}", i, j, "X") for i in range(n) for j in range(n)]
    frame = spark.createDataFrame(edges, "clean_name string, domain string, url string, feed_ord bigint, pos bigint, name string")
    group = "mirrors"
    spark.sparkContext.setJobGroup(group, group)
    got = {(r.domain, r.url) for r in registry._greedy(frame).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    assert got == {(f"d{i:02}", f"u{i:02}") for i in range(n)} and len(jobs) <= 3


def test_registry_fixture_is_that_of_the_listings(spark):
    """Games and sources from numbers are those grouped by their texts, and are not dealt by these."""
    root = "/root/testdata/sf0.001"
    old = fx.old_listings(spark, root)
    games, sources = fx.registry(spark, root, fx.LISTED_BEFORE)
    for got, expected in ((games, fx.games_of(old)), (sources, fx.sources_of(old))):
        assert got.columns == expected.columns and got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
