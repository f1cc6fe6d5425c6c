import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import dashboard, feeds, maintenance, quality, reports

DIFF = "feed_ord bigint, domain string, pos bigint, url string"
CHECKS = "feed_ord bigint, domain string, success boolean, threw boolean, timeout boolean"


@pytest.fixture(scope="module")
def diff(spark):
    rows = [(0, "a", i, f"https://a/x/word-{i % 2}") for i in range(5)] + [(2, "b", 0, "https://b/page/123/news.html/Keep")]
    return spark.createDataFrame(rows, DIFF)


@pytest.fixture(scope="module")
def checks(spark):
    rows = [(0, "a", True, False, False), (1, "c", True, False, False), (2, "b", True, False, False), (3, "e", False, False, True), (4, "f", False, True, False)]
    return spark.createDataFrame(rows, CHECKS)


def test_domains(spark, checks, diff):
    totals = reports.by_domain(checks, diff)
    assert {(r.domain, r.total_new) for r in totals.collect()} == {("a", 5), ("b", 1), ("c", 0)}
    assert [r.domain for r in reports.ranked_domains(totals).collect()] == ["a", "b"]
    shown, others = reports.first_domains(totals, 1)
    assert ([r.domain for r in shown.collect()], others.first().others) == (["a"], 2)
    sample = {r.domain: (len(r.samples), r.remaining) for r in reports.domain_samples(diff).collect()}
    assert sample == {"a": (3, 2), "b": (1, 0)}
    assert [r.n for r in reports.domain_urls(diff).filter("domain = 'a'").orderBy("n").collect()] == [1, 2, 3, 4, 5]
    notice = reports.feed_notice(diff, 2).orderBy("feed_ord", "no").collect()
    assert [(r.feed_ord, r.no, r.total, r.remaining) for r in notice] == [(0, 1, 5, 3), (0, 2, 5, 3), (2, 1, 1, 0)]
    assert reports.feed_notice(diff).count() == 6


def test_keywords(spark, diff):
    assert [(r.keyword, r["count"]) for r in reports.top_keywords(diff).collect()] == [("word0", 3), ("word1", 2), ("keep", 1)]
    assert [r.keyword for r in reports.distinct_keywords(diff).collect()] == ["page", "news.html", "Keep"]
    assert [r.domain for r in reports.host_distribution(diff).collect()] == ["a", "b"]


def test_keyword_ties_follow_appearance(spark):
    rows = [(0, "a", 0, "https://a/zeta/alpha"), (0, "a", 1, "https://a/beta"), (1, "a", 0, "https://a/aaa")]
    df = spark.createDataFrame(rows, DIFF)
    assert [r.keyword for r in reports.top_keywords(df).collect()] == ["zeta", "alpha", "beta", "aaa"]


def test_totals(spark, checks, diff):
    def row(rule, changes=diff):
        return reports.run_totals(checks, changes, rule).first().asDict()

    assert row("scheduled") == {"feeds": 5, "processed": 4, "errors": 2, "new_urls": 6}
    assert row("manual") == {"feeds": 5, "processed": 4, "errors": 1, "new_urls": 6}
    assert row("chat") == {"feeds": 5, "success": 3, "errors": 2, "timeouts": 1, "progress": 80, "new_urls": 6}
    changes = spark.createDataFrame([("a", True, False), ("a", False, True)], "domain string, is_new boolean, is_cross boolean")
    assert row("v2", changes) == {"feeds": 5, "processed": 4, "errors": 2, "new_games": 1, "cross_platform": 1}
    with pytest.raises(ValueError):
        row("other")
    assert spark.range(1).select(reports.progress(F.lit(1), F.lit(3))).first()[0] == 33


def test_composed(spark, checks, diff):
    unified = reports.unified_report(checks, diff)
    assert [r.domain for r in unified["domains"].collect()] == ["a", "b"]
    embed = reports.embed_report(checks, diff)
    assert embed["summary"].first().has_news and embed["summary"].first().others == 0
    assert reports.keyword_digest(checks, diff).first().keywords == "page, news.html, Keep"
    assert reports.keyword_report(diff)["total"].first().total_new == 6


T = dt.datetime


@pytest.fixture(scope="module")
def games(spark):
    rows = [
        ("1", "One", "one", 1, 1.0, T(2024, 1, 1)), ("2", "Two", "two", 2, 1.5, T(2024, 1, 2)),
        ("3", "Three", "three", 3, 2.0, T(2024, 1, 3)), ("4", "Four", "four", 9, 2.5, None), ("5", "Five", "five", 4, 2.5, T(2024, 1, 1)),
    ]
    return spark.createDataFrame(rows, "id string, name string, clean_name string, platform_count int, score float, first_seen timestamp")


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("2", "d1", "u1"), ("2", "d2", "u2"), ("3", "d1", "u3"), ("5", "d1", "u4"), (None, "d9", "u5")]
    return spark.createDataFrame(rows, "game_id string, domain string, url string").withColumn("first_seen", F.lit("2024-01-02").cast("timestamp"))


def test_pages(games, sources):
    def ids(**kw):
        return [r.id for r in dashboard.games(games, sources, **kw).collect()]

    assert ids() == ["4", "5", "3", "2", "1"]
    assert ids(min_platforms=2, limit=2) == ["4", "5"]
    assert ids(limit=2, offset=1) == ["5", "3"]
    assert ids(offset=3) == ["2", "1"]
    assert ids(search="O") == ["4", "2", "1"]
    assert ids(search="t_r") == ["3"] and ids(search="t_o") == ["2"] and ids(search="_wo") == ["2"]
    assert ids(domain="d1", limit=2) == ["5"]
    assert ids(domain="d1", limit=2, domain_before_paging=True) == ["5", "3"]
    assert [r.id for r in dashboard.top_games(games, sources, 3).collect()] == ["4", "5", "3"]
    rows = {r.id: [s.url for s in r.game_sources] for r in dashboard.nested(games, sources).collect()}
    assert rows == {"1": [], "2": ["u1", "u2"], "3": ["u3"], "4": [], "5": ["u4"]}
    short = {r.id: [s.url for s in r.game_sources] for r in dashboard.nested(games, sources, first_sources=1).collect()}
    assert short == {**rows, "2": ["u1"]}
    numbered = {(r.game_id, r.n, r.url) for r in dashboard.numbered_sources(sources).collect()}
    assert {("2", 1, "u1"), ("2", 2, "u2"), ("3", 1, "u3"), ("5", 1, "u4")} <= numbered


def test_no_source_is_lost(spark, games):
    many = spark.range(1500).select(F.lit("2").alias("game_id"), F.lit("d1").alias("domain"), F.format_string("u%04d", "id").alias("url"))
    for rows in (dashboard.nested(games, many), dashboard.games(games, many, limit=5)):
        urls = {r.id: [s.url for s in r.game_sources] for r in rows.collect()}
        assert urls["2"] == [f"u{i:04}" for i in range(1500)]


def test_cards(games):
    cards = {r.clean_name: r for r in dashboard.card(games).collect()}
    assert [cards[n].score_tier for n in ("one", "two", "three", "four")] == ["gray", "cyan", "yellow", "magenta"]
    assert [cards[n].platform_tier for n in ("one", "two", "three", "four")] == ["gray", "cyan", "yellow", "magenta"]
    assert (cards["two"].bar, cards["two"].score_text, cards["one"].is_cross) == (60.0, "1.5", False)


def test_orphans_and_purges(games, sources):
    assert quality.orphans(games, sources).isEmpty()
    assert {r.id for r in quality.orphans(games, sources, null_aware=False).collect()} == {"1", "4"}
    whole = sources.filter("game_id is not null")
    assert {r.id for r in quality.orphans(games, whole).collect()} == {"1", "4"}
    assert {r.id for r in maintenance.purge_orphans(games, whole).collect()} == {"2", "3", "5"}
    assert quality.orphans(games, sources.filter("false")).count() == 5
    assert maintenance.cascade_delete(sources, games.filter("id = '2'")).count() == 3


def test_retention_is_strict_and_keeps_undated(spark):
    logs = spark.createDataFrame([(1, T(2024, 1, 1)), (2, T(2024, 1, 2)), (3, None)], "id int, checked_at timestamp")
    kept, deleted = maintenance.retain_logs(logs, "2024-02-01", 30)
    assert ({r.id for r in kept.collect()}, deleted.first().deleted) == ({2, 3}, 1)


def test_days_are_strict(games):
    assert [(str(r.date), r.new_games) for r in quality.new_per_day(games, "2024-01-09", 7).collect()] == [("2024-01-03", 1)]
    assert quality.new_today(games, "2024-01-03 23:00:00").first().today_new_games == 1


def test_feed_lists(spark):
    rows = [("1", "https://a/sitemap", "a", None, None), ("2", "https://b/sitemap", "b", T(2024, 1, 2), None), ("3", "https://c/sitemap", "b", T(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "id string, url string, domain string, created_at timestamp, updated_at timestamp")
    assert [r.id for r in feeds.list_feeds(df).collect()] == ["3", "2", "1"]
    assert [r.id for r in feeds.list_feeds(df, newest_first=True).collect()] == ["1", "2", "3"]
    assert [r.domain for r in feeds.distinct_domains(df).collect()] == ["a", "b"]
    assert {r.id: r.feed_ord for r in feeds.feed_order(df).collect()} == {"3": 0, "2": 1, "1": 2}
    taken, count = feeds.cap_feeds(df, 2)
    assert ([r.id for r in taken.collect()], count.first().skipped) == (["3", "2"], 1)
    assert feeds.cap_feeds(df)[1].first().skipped == 0
    adds = spark.createDataFrame([("https://b/sitemap",), ("https://n/sitemap",), ("https://n/sitemap",)], "url string")
    grown, rejects = feeds.insert_feeds(df, adds, "2024-03-01")
    assert grown.count() == 4 and {r.url: r.rejected for r in rejects.collect()} == {"https://b/sitemap": 1, "https://n/sitemap": 1}
    upserted = {r.url: r for r in feeds.upsert_feeds(df, adds, "2024-03-01").collect()}
    assert upserted["https://b/sitemap"].created_at == T(2024, 1, 2) and upserted["https://b/sitemap"].updated_at == T(2024, 3, 1)
    assert len(upserted) == 4 and upserted["https://n/sitemap"].domain == "n"


def test_append_labels(spark):
    have = spark.createDataFrame([(0, "u0")], "feed_ord bigint, url string")
    adds = spark.createDataFrame([(0, "u0"), (1, "u1"), (2, "bad"), (3, "u1")], "add_ord bigint, url string")
    checks = spark.createDataFrame([("u0", True, ""), ("u1", True, ""), ("bad", False, "HTTP 500")], "url string, success boolean, error string")
    grown, outcome = feeds.append_feeds(have, adds, checks)
    assert [r.outcome for r in outcome.orderBy("add_ord").collect()] == ["updated", "added", "failed", "updated"]
    assert [r.url for r in grown.orderBy("feed_ord").collect()] == ["u0", "u1"]


def test_validation(spark):
    urls = ["https://a/SiteMap.xml", "https://a/feed", "sitemap", " ", None]
    ok, rejects = feeds.validate_feeds(spark.createDataFrame([(u,) for u in urls], "url string"))
    assert [r.url for r in ok.collect()] == urls[:1]
    assert {r.url: r.reject_reason for r in rejects.collect()} == {"https://a/feed": "not a sitemap", "sitemap": "invalid url", " ": "blank", None: "blank"}
