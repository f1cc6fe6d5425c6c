"""Report, dashboard and quality queries (2.5-2.8, 2.11 of the inventory)."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import dashboard, diff, feeds, guards, maintenance, quality, registry, reports
from ..operators.name_search import search_names, write_name_index
from ..operators.ranking import number_rows
from ..session import shared_path
from . import fixtures as fx
from .fixtures import AS_OF, EVENTS_AS_OF, day, second, with_ctes
from .registry import query


def _diff(spark, d):
    rows = diff.diff_urls(fx.new_stores(spark, d), fx.old_stores(spark, d))
    ok = _checks(spark, d).filter("success").select("domain")
    return rows.join(ok, "domain", "left_semi").select("feed_ord", "domain", "pos", "url")


def _checks(spark, d):
    """One feed per store.  First checks that are too small stand for feeds that threw."""
    new, old = fx.new_stores(spark, d), fx.old_stores(spark, d)
    feeds_ = fx.stores(spark, d).select("domain", "feed_ord").distinct()
    status = F.col("status")
    return guards.classify_checks(new, old).join(feeds_, "domain").select(
        "domain",
        "feed_ord",
        "status",
        guards.is_success(status).alias("success"),
        (status == "first_small").alias("threw"),
        (status == "zero").alias("timeout"),
    )


_CHECKS = (
    with_ctes("new_stores", "old_stores").rstrip()
    + """,
counts AS (SELECT domain, any_value(feed_ord) AS feed_ord, sum(n) AS n, sum(o) AS o FROM
  (SELECT domain, feed_ord, 1 AS n, 0 AS o FROM new_stores UNION ALL SELECT domain, feed_ord, 0, 1 FROM old_stores)
  GROUP BY domain),
checks AS (SELECT *, status IN ('ok', 'first_ok') AS success FROM (SELECT *, CASE WHEN n = 0 THEN 'zero'
  WHEN o = 0 AND n < 10 THEN 'first_small' WHEN o = 0 THEN 'first_ok' WHEN n < o * 0.5 THEN 'shrunk' ELSE 'ok' END AS status FROM counts)),
diff AS (SELECT n.feed_ord, n.domain, n.pos, n.url FROM new_stores n JOIN checks c ON c.domain = n.domain
  WHERE c.success AND NOT EXISTS (SELECT 1 FROM old_stores o WHERE o.domain = n.domain AND o.url = n.url)),
totals AS (SELECT c.domain, c.feed_ord AS first_feed, (SELECT count(*) FROM diff d WHERE d.domain = c.domain) AS total_new
  FROM checks c WHERE c.success),
numbered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY feed_ord, pos, url) AS n FROM diff)
"""
)


def placed(df):
    """Adds the row's place in the frame's own order, so that the order is compared too."""
    own = df.withColumn("_own", F.monotonically_increasing_id())
    return number_rows(own, [F.col("_own")], "place").select(*df.columns, (F.col("place") + 1).alias("place"))


def _place(order: str) -> str:
    return f"row_number() OVER (ORDER BY {order}) AS place"


@query("all_new_urls", _CHECKS + f"SELECT feed_ord, pos, domain, url, {_place('feed_ord, pos')} FROM diff")
def all_new_urls(spark, d):
    return placed(reports.new_urls(_diff(spark, d)))


@query("domain_totals", _CHECKS + "SELECT domain, total_new, first_feed FROM totals")
def domain_totals(spark, d):
    return reports.by_domain(_checks(spark, d), _diff(spark, d))


@query(
    "domains_with_news",
    _CHECKS
    + f"SELECT domain, total_new, first_feed, {_place('total_new DESC, first_feed')} FROM totals WHERE total_new > 0",
)
def domains_with_news(spark, d):
    return placed(reports.ranked_domains(reports.by_domain(_checks(spark, d), _diff(spark, d))))


@query("domain_url_lists", _CHECKS + "SELECT domain, n, url FROM numbered")
def domain_url_lists(spark, d):
    return reports.domain_urls(_diff(spark, d))


_SAMPLES = """
samples AS (SELECT domain, count(*) AS total_new, greatest(count(*) - 3, 0) AS remaining,
  string_agg(url, ' ' ORDER BY n) FILTER (n <= 3) AS samples FROM numbered GROUP BY domain)
"""


@query("domain_samples", _CHECKS.rstrip() + "," + _SAMPLES + "SELECT * FROM samples")
def domain_samples(spark, d):
    return reports.domain_samples(_diff(spark, d)).withColumn("samples", F.array_join("samples", " "))


@query(
    "first10_domains",
    _CHECKS + "SELECT domain, total_new, first_feed FROM totals WHERE total_new > 0 ORDER BY first_feed, domain LIMIT 10",
)
def first10_domains(spark, d):
    return reports.first_domains(reports.by_domain(_checks(spark, d), _diff(spark, d)))[0]


@query("other_domains", _CHECKS + "SELECT greatest(count(*) - 10, 0) AS others FROM totals")
def other_domains(spark, d):
    return reports.first_domains(reports.by_domain(_checks(spark, d), _diff(spark, d)))[1]


@query(
    "feed_notice_all",
    _CHECKS
    + """SELECT feed_ord, domain, n AS no, url, count(*) OVER (PARTITION BY feed_ord) AS total, 0::BIGINT AS remaining FROM numbered""",
)
def feed_notice_all(spark, d):
    return reports.feed_notice(_diff(spark, d))


@query(
    "feed_notice_batch",
    _CHECKS
    + """SELECT * FROM (SELECT feed_ord, domain, CAST(n AS INTEGER) AS no, url, count(*) OVER (PARTITION BY feed_ord) AS total,
           greatest(count(*) OVER (PARTITION BY feed_ord) - 5, 0) AS remaining FROM numbered) WHERE no <= 5""",
)
def feed_notice_batch(spark, d):
    return reports.feed_notice(_diff(spark, d), 5)


_CHANGED = "(SELECT count(*) FROM diff)"


def _totals(errors: str) -> str:
    return _CHECKS + f"""SELECT count(*) AS feeds, count(*) FILTER (status <> 'first_small') AS processed,
      count(*) FILTER ({errors}) AS errors, {_CHANGED} AS new_urls FROM checks"""


@query("run_totals_scheduled", _totals("NOT success"))
def run_totals_scheduled(spark, d):
    return reports.run_totals(_checks(spark, d), _diff(spark, d), "scheduled")


@query("run_totals_manual", _totals("status = 'first_small'"))
def run_totals_manual(spark, d):
    return reports.run_totals(_checks(spark, d), _diff(spark, d), "manual")


_CHAT = """SELECT count(*) AS feeds, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS errors,
  count(*) FILTER (status = 'zero') AS timeouts, CAST(round(count(*) FILTER (status <> 'first_small') * 100.0 / count(*)) AS INTEGER) AS progress, {} AS new_urls FROM checks"""


@query("run_totals_chat", _CHECKS + _CHAT.format(_CHANGED))
def run_totals_chat(spark, d):
    return reports.run_totals(_checks(spark, d), _diff(spark, d), "chat")


def _changes(spark, d):
    """Open listings: first mention of an entity is new, the first on each further site cross-platform."""
    rows = fx.new_listings(spark, d)
    firsts = registry.first_per(
        rows.select("clean_name", "domain", "feed_ord", "pos", "url"), ["clean_name", "domain"], ["feed_ord", "pos", "url"]
    )
    first = rows.groupBy("clean_name").agg(F.min("feed_ord").alias("f"))
    marked = firsts.join(first, "clean_name")
    return marked.select(
        "domain", (F.col("feed_ord") == F.col("f")).alias("is_new"), (F.col("feed_ord") != F.col("f")).alias("is_cross")
    )


_CHANGES = """changes AS (SELECT DISTINCT clean_name, domain, feed_ord = min(feed_ord) OVER (PARTITION BY clean_name) AS is_new FROM new_listings)
"""


@query(
    "run_totals_v2",
    (_CHECKS.rstrip() + "," + with_ctes("new_listings")[len("WITH RECURSIVE ") :].rstrip() + "," + _CHANGES)
    + """SELECT count(*) AS feeds, count(*) FILTER (status <> 'first_small') AS processed, count(*) FILTER (NOT success) AS errors,
           (SELECT count(*) FILTER (is_new) FROM changes) AS new_games,
           (SELECT count(*) FILTER (NOT is_new) FROM changes) AS cross_platform FROM checks""",
)
def run_totals_v2(spark, d):
    return reports.run_totals(_checks(spark, d), _changes(spark, d), "v2")


@query(
    "run_report_domains",
    with_ctes("new_listings").rstrip()
    + ","
    + _CHANGES
    + "SELECT domain, count(*) FILTER (is_new) AS new_games, count(*) FILTER (NOT is_new) AS cross_platform FROM changes GROUP BY domain",
)
def run_report_domains(spark, d):
    return reports.run_report(_checks(spark, d), _changes(spark, d), fx.logs(spark, d), fx.at(EVENTS_AS_OF))["domains"]


@query("unified_report_summary", _totals("NOT success"))
def unified_report_summary(spark, d):
    return reports.unified_report(_checks(spark, d), _diff(spark, d))["summary"]


@query(
    "unified_report_domains",
    _CHECKS.rstrip()
    + ","
    + _SAMPLES
    + "SELECT s.*, t.first_feed FROM samples s JOIN totals t ON t.domain = s.domain",
)
def unified_report_domains(spark, d):
    rows = reports.unified_report(_checks(spark, d), _diff(spark, d))["domains"]
    return rows.withColumn("samples", F.array_join("samples", " "))


# The path of a store URL is /play/order-<n>: its keywords are `play` and `order<n>`.
_WORDS = """
words AS (SELECT feed_ord, pos, 0 AS seg, 'play' AS keyword FROM diff UNION ALL
  SELECT feed_ord, pos, 1, 'order' || pos FROM diff)
"""
_TOP = "SELECT keyword, count(*) AS count FROM words GROUP BY keyword ORDER BY count(*) DESC, min((feed_ord, pos, seg)) LIMIT 10"


@query("unified_report_keywords", _CHECKS.rstrip() + "," + _WORDS + _TOP)
def unified_report_keywords(spark, d):
    return reports.unified_report(_checks(spark, d), _diff(spark, d))["keywords"]


@query(
    "keyword_host_summary",
    _CHECKS.rstrip()
    + ","
    + _WORDS
    + f"""SELECT 'total' AS part, '' AS label, count(*) AS count FROM diff UNION ALL SELECT 'keyword', keyword, count FROM ({_TOP})
          UNION ALL SELECT 'host', domain, count(*) FROM diff GROUP BY domain""",
)
def keyword_host_summary(spark, d):
    report = reports.keyword_report(_diff(spark, d))
    total = report["total"].select(F.lit("total").alias("part"), F.lit("").alias("label"), F.col("total_new").alias("count"))
    words = report["keywords"].select(F.lit("keyword").alias("part"), F.col("keyword").alias("label"), "count")
    hosts = report["hosts"].select(F.lit("host").alias("part"), F.col("domain").alias("label"), "count")
    return total.unionByName(words).unionByName(hosts)


@query(
    "embed_report",
    _CHECKS
    + f"""SELECT count(*) AS feeds, count(*) FILTER (status <> 'first_small') AS processed, count(*) FILTER (NOT success) AS errors,
            {_CHANGED} AS new_urls, {_CHANGED} > 0 AS has_news, (SELECT greatest(count(*) - 10, 0) FROM totals) AS others FROM checks""",
)
def embed_report(spark, d):
    return reports.embed_report(_checks(spark, d), _diff(spark, d))["summary"]


# --- dashboard -------------------------------------------------------------


@query(
    "stats_card",
    with_ctes("games", "feeds")
    + """SELECT count(*) AS total_games, count(*) FILTER (platform_count >= 2) AS cross_platform_games,
           count(*) FILTER (score >= 2.0) AS high_score_games, (SELECT count(*) FROM feeds) AS total_platforms FROM games""",
)
def stats_card(spark, d):
    return dashboard.stats(fx.games(spark, d), fx.feeds(spark, d))


def _shown(df):
    """A page of games with the source list as text."""
    text = F.array_join(F.transform("game_sources", lambda s: F.concat(s["domain"], F.lit(" "), s["url"])), ",")
    return df.select(
        "clean_name",
        "platform_count",
        F.col("score").cast("double").alias("score"),
        day("first_seen").alias("first_seen"),
        text.alias("game_sources"),
    )


def _page_sql(page: str) -> str:
    return (
        with_ctes("games", "sources").rstrip()
        + f""", page AS ({page})
SELECT p.clean_name, p.platform_count, p.score, strftime(p.first_seen, '%Y-%m-%d') AS first_seen,
  string_agg(s.domain || ' ' || s.url, ',' ORDER BY s.domain, s.url) AS game_sources
FROM page p LEFT JOIN sources s ON s.game_id = p.id GROUP BY p.clean_name, p.platform_count, p.score, p.first_seen"""
    )


_BEST = "ORDER BY score DESC, first_seen DESC, clean_name"


@query("game_list_page", _page_sql(f"SELECT * FROM games WHERE platform_count >= 2 AND name ILIKE '%ring%' {_BEST} LIMIT 30 OFFSET 30"))
def game_list_page(spark, d):
    return _shown(
        dashboard.games(fx.games(spark, d), fx.sources(spark, d), min_platforms=2, search="ring", limit=30, offset=30)
    )


# Whole words, wildcards of both kinds, upper case, fewer than three letters, and a name that does not occur.
SEARCHES = ("ring", "red_w", "gr%-1%a", "GREEN-", "-7", "o_%k", "no such game")


@query(
    "game_search_indexed",
    with_ctes("games")
    + f"""SELECT search, clean_name, platform_count, score FROM games
           JOIN (SELECT unnest({list(SEARCHES)}) AS search) ON name ILIKE '%' || search || '%'""",
)
def game_search_indexed(spark, d):
    """Several searches over one stored catalog with a trigram index."""
    path = shared_path(spark, "names")
    write_name_index(fx.games(spark, d), path)
    found = [search_names(spark, path, s).select(F.lit(s).alias("search"), "clean_name", "platform_count", "score") for s in SEARCHES]
    return reduce(lambda a, b: a.unionAll(b), found)


_ON_SITE = "id IN (SELECT game_id FROM sources WHERE domain = 's5.example.com')"


@query("game_list_of_domain", _page_sql(f"SELECT * FROM (SELECT * FROM games {_BEST} LIMIT 200) WHERE {_ON_SITE}"))
def game_list_of_domain(spark, d):
    return _shown(dashboard.games(fx.games(spark, d), fx.sources(spark, d), domain="s5.example.com", limit=200))


@query("game_list_domain_first", _page_sql(f"SELECT * FROM games WHERE {_ON_SITE} {_BEST} LIMIT 50 OFFSET 10"))
def game_list_domain_first(spark, d):
    rows = dashboard.games(
        fx.games(spark, d), fx.sources(spark, d), domain="s5.example.com", offset=10, domain_before_paging=True
    )
    return _shown(rows)


@query("top_games", _page_sql(f"SELECT * FROM games WHERE platform_count >= 2 {_BEST} LIMIT 20"))
def top_games(spark, d):
    return _shown(dashboard.top_games(fx.games(spark, d), fx.sources(spark, d)))


@query("dashboard_top6", _page_sql(f"SELECT * FROM games WHERE platform_count >= 2 {_BEST} LIMIT 6"))
def dashboard_top6(spark, d):
    return _shown(dashboard.dashboard_top(fx.games(spark, d), fx.sources(spark, d)))


@query("nested_games", _page_sql("SELECT * FROM games"))
def nested_games(spark, d):
    return _shown(dashboard.nested(*fx.registry(spark, d)))


@query(
    "game_sources_numbered",
    with_ctes("games", "sources")
    + """SELECT g.clean_name, s.domain, s.url, row_number() OVER (PARTITION BY s.game_id ORDER BY s.domain, s.url) AS n
         FROM sources s JOIN games g ON g.id = s.game_id""",
)
def game_sources_numbered(spark, d):
    numbered = dashboard.numbered_sources(fx.sources(spark, d))
    names = fx.games(spark, d).select(F.col("id").alias("game_id"), "clean_name")
    return numbered.join(names, "game_id").select("clean_name", "domain", "url", "n")


@query("high_score_games", with_ctes("games") + "SELECT clean_name, score FROM games WHERE score >= 2.0")
def high_score_games(spark, d):
    return dashboard.high_score(fx.games(spark, d)).select("clean_name", F.col("score").cast("double").alias("score"))


@query(
    "filtered_count",
    with_ctes("games") + "SELECT count(*) AS shown FROM games WHERE platform_count >= 3 AND name ILIKE '%red_w%'",
)
def filtered_count(spark, d):
    page = dashboard.games_page(fx.games(spark, d), fx.sources(spark, d), min_platforms=3, search="red_w")
    return dashboard.count_shown(page)


@query(
    "card_tiers",
    with_ctes("games")
    + """SELECT name, clean_name, platform_count, printf('%.1f', score) AS score_text,
           CASE WHEN score >= 2.5 THEN 'magenta' WHEN score >= 2.0 THEN 'yellow' WHEN score >= 1.5 THEN 'cyan' ELSE 'gray' END AS score_tier,
           CASE WHEN platform_count >= 4 THEN 'magenta' WHEN platform_count >= 3 THEN 'yellow' WHEN platform_count >= 2 THEN 'cyan'
             ELSE 'gray' END AS platform_tier,
           score / 2.5::DOUBLE * 100 AS bar, platform_count >= 2 AS is_cross, strftime(first_seen, '%Y-%m-%d') AS first_seen_on FROM games""",
)
def card_tiers(spark, d):
    return dashboard.card(fx.games(spark, d)).withColumn("first_seen_on", day("first_seen_on"))


# --- quality ---------------------------------------------------------------

_PER_DOMAIN = """SELECT domain, count(DISTINCT game_id) AS game_count, strftime(min(first_seen), '%Y-%m-%d') AS first_added,
  strftime(max(first_seen), '%Y-%m-%d') AS last_added FROM sources GROUP BY domain"""


def _dated(df, *cols):
    for c in cols:
        df = df.withColumn(c, day(c))
    return df


@query("games_per_domain", with_ctes("sources") + _PER_DOMAIN)
def games_per_domain(spark, d):
    return _dated(quality.domain_summary(fx.sources(spark, d)), "first_added", "last_added")


@query("games_per_domain_top20", with_ctes("sources") + _PER_DOMAIN + " ORDER BY game_count DESC, domain LIMIT 20")
def games_per_domain_top20(spark, d):
    return _dated(quality.domain_summary(fx.sources(spark, d), 20), "first_added", "last_added")


@query(
    "new_per_day",
    with_ctes("logs")
    + f"""SELECT strftime(checked_at, '%Y-%m-%d') AS date, count(*) AS new_games,
          row_number() OVER (ORDER BY strftime(checked_at, '%Y-%m-%d') DESC) AS place FROM logs
          WHERE checked_at > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY GROUP BY 1""",
)
def new_per_day(spark, d):
    return _dated(placed(quality.new_per_day(fx.logs(spark, d), fx.at(EVENTS_AS_OF), at="checked_at")), "date")


@query(
    "recent_games",
    with_ctes("games") + f"SELECT clean_name FROM games WHERE first_seen > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY",
)
def recent_games(spark, d):
    return quality.recent(fx.games(spark, d), fx.at(AS_OF)).select("clean_name")


@query(
    "today_count",
    with_ctes("games")
    + f"SELECT count(*) AS today_new_games FROM games WHERE CAST(first_seen AS DATE) = CAST(TIMESTAMP '{AS_OF}' AS DATE)",
)
def today_count(spark, d):
    return quality.new_today(fx.games(spark, d), fx.at(AS_OF))


@query(
    "games_today",
    with_ctes("games") + f"SELECT clean_name FROM games WHERE CAST(first_seen AS DATE) = CAST(TIMESTAMP '{AS_OF}' AS DATE)",
)
def games_today(spark, d):
    return quality.on_day(fx.games(spark, d), fx.at(AS_OF)).select("clean_name")


@query(
    "games_since",
    with_ctes("games")
    + f"""SELECT name, platform_count, strftime(first_seen, '%Y-%m-%d') AS first_seen,
          {_place('games.first_seen DESC NULLS FIRST, name')} FROM games WHERE first_seen > TIMESTAMP '{AS_OF}'""",
)
def games_since(spark, d):
    return _dated(placed(quality.games_since(fx.games(spark, d), fx.at(AS_OF))), "first_seen")


def _snapshots(spark, d):
    """One snapshot per store with its number of orders, last updated with the last order."""
    rows = fx.stores(spark, d).groupBy("domain")
    return rows.agg(F.count("*").alias("url_count"), F.max("o_orderdate").alias("updated_at"))


_SNAPSHOTS = (
    with_ctes("stores").rstrip()
    + ", snapshots AS (SELECT domain, count(*) AS url_count, max(o_orderdate) AS updated_at FROM stores GROUP BY domain)\n"
)
_SMALL = "SELECT domain, url_count, strftime(updated_at, '%Y-%m-%d') AS updated_at, {place} FROM snapshots WHERE url_count < 10"


@query("implausible_snapshots", _SNAPSHOTS + _SMALL.format(place=_place("snapshots.updated_at DESC NULLS FIRST, domain")))
def implausible_snapshots(spark, d):
    return _dated(placed(quality.implausible(_snapshots(spark, d))), "updated_at")


@query("implausible_by_count", _SNAPSHOTS + _SMALL.format(place=_place("url_count, domain")))
def implausible_by_count(spark, d):
    return _dated(placed(quality.implausible(_snapshots(spark, d), order="count")), "updated_at")


@query("implausible_count", _SNAPSHOTS + "SELECT count(*) AS count FROM snapshots WHERE url_count < 10")
def implausible_count(spark, d):
    return quality.implausible_count(_snapshots(spark, d))


@query("purge_snapshots", _SNAPSHOTS + "SELECT domain, url_count FROM snapshots WHERE url_count >= 10")
def purge_snapshots(spark, d):
    return maintenance.purge_snapshots(_snapshots(spark, d)).select("domain", "url_count")


@query("remaining_snapshots", _SNAPSHOTS + "SELECT count(*) AS remaining_sitemaps FROM snapshots WHERE url_count >= 10")
def remaining_snapshots(spark, d):
    return quality.snapshot_count(maintenance.purge_snapshots(_snapshots(spark, d)))


_OVERVIEW = """SELECT (SELECT count(*) FROM games) AS total_games, (SELECT count(*) FROM sources) AS total_sources,
  (SELECT count(*) FROM snapshots) AS total_sitemaps, (SELECT count(*) FROM snapshots WHERE url_count < 10) AS invalid_sitemaps"""
_ALL = (
    with_ctes("games", "sources", "stores").rstrip()
    + ", snapshots AS (SELECT domain, count(*) AS url_count, max(o_orderdate) AS updated_at FROM stores GROUP BY domain)\n"
)


@query("overview", _ALL + _OVERVIEW)
def overview(spark, d):
    return quality.overview(fx.games(spark, d), fx.sources(spark, d), _snapshots(spark, d))


@query(
    "quality_report",
    _ALL
    + f"""SELECT 'implausible snapshots' AS category, '' AS label, count(*) AS count FROM snapshots WHERE url_count < 10
UNION ALL SELECT 'recent growth', strftime(first_seen, '%Y-%m-%d'), count(*) FROM games
  WHERE first_seen > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'games per domain', domain, count(DISTINCT game_id) FROM sources GROUP BY domain
  ORDER BY 3 DESC, 2 LIMIT 20)
UNION ALL SELECT 'new today', '', count(*) FROM games WHERE CAST(first_seen AS DATE) = CAST(TIMESTAMP '{AS_OF}' AS DATE)
UNION ALL SELECT 'overview', 'games', count(*) FROM games UNION ALL SELECT 'overview', 'sources', count(*) FROM sources
UNION ALL SELECT 'overview', 'snapshots', count(*) FROM snapshots
UNION ALL SELECT 'overview', 'invalid', count(*) FROM snapshots WHERE url_count < 10""",
)
def quality_report(spark, d):
    report = quality.quality_report(fx.games(spark, d), fx.sources(spark, d), _snapshots(spark, d), fx.at(AS_OF))
    none = F.lit("").alias("label")
    overview_ = report["overview"].selectExpr(
        "category",
        """stack(4, 'games', total_games, 'sources', total_sources, 'snapshots', total_sitemaps,
             'invalid', invalid_sitemaps) AS (label, count)""",
    )
    return (
        report["implausible_count"].select("category", none, "count")
        .unionByName(report["growth"].select("category", day("date").alias("label"), F.col("new_games").alias("count")))
        .unionByName(report["domains"].select("category", F.col("domain").alias("label"), F.col("game_count").alias("count")))
        .unionByName(report["today"].select("category", none, F.col("today_new_games").alias("count")))
        .unionByName(overview_)
    )


@query(
    "latest_for_domain",
    with_ctes("games", "sources")
    + """SELECT g.name, g.platform_count, s.url, strftime(s.first_seen, '%Y-%m-%d') AS first_seen FROM games g
         JOIN sources s ON s.game_id = g.id WHERE s.domain = 's5.example.com' ORDER BY s.first_seen DESC, s.url LIMIT 20""",
)
def latest_for_domain(spark, d):
    return _dated(quality.domain_games(fx.games(spark, d), fx.sources(spark, d), "s5.example.com"), "first_seen")


@query("domain_sources", with_ctes("sources") + "SELECT id, url FROM sources WHERE domain = 's5.example.com'")
def domain_sources(spark, d):
    return quality.domain_sources(fx.sources(spark, d), "s5.example.com").select("id", "url")


def _late_sources(spark, d):
    return maintenance.purge_since(fx.sources(spark, d), fx.at(AS_OF))


_LATE = with_ctes("games", "sources").rstrip() + f", kept AS (SELECT * FROM sources WHERE first_seen <= TIMESTAMP '{AS_OF}')\n"


@query("orphans", _LATE + "SELECT clean_name FROM games WHERE id NOT IN (SELECT game_id FROM kept)")
def orphans(spark, d):
    return quality.orphans(fx.games(spark, d), _late_sources(spark, d)).select("clean_name")


def _torn_sources(spark, d):
    """Sources of one site lost their game."""
    lost = F.when(F.col("domain") != "s3.example.com", F.col("game_id"))
    return _late_sources(spark, d).withColumn("game_id", lost)


_TORN = _LATE.rstrip() + ", torn AS (SELECT CASE WHEN domain <> 's3.example.com' THEN game_id END AS game_id FROM kept)\n"


@query("orphans_null_aware", _TORN + "SELECT clean_name FROM games WHERE id NOT IN (SELECT game_id FROM torn)")
def orphans_null_aware(spark, d):
    return quality.orphans(fx.games(spark, d), _torn_sources(spark, d)).select("clean_name")


@query(
    "orphans_safe",
    _TORN + "SELECT clean_name FROM games WHERE id NOT IN (SELECT game_id FROM torn WHERE game_id IS NOT NULL)",
)
def orphans_safe(spark, d):
    return quality.orphans(fx.games(spark, d), _torn_sources(spark, d), null_aware=False).select("clean_name")


@query("purge_orphans", _LATE + "SELECT clean_name FROM games WHERE id IN (SELECT game_id FROM kept)")
def purge_orphans(spark, d):
    return maintenance.purge_orphans(fx.games(spark, d), _late_sources(spark, d)).select("clean_name")


@query("distinct_game_ids", with_ctes("sources") + "SELECT DISTINCT game_id FROM sources")
def distinct_game_ids(spark, d):
    return quality.source_game_ids(fx.sources(spark, d))


@query(
    "cascade_delete",
    with_ctes("games", "sources")
    + "SELECT url FROM sources WHERE game_id NOT IN (SELECT id FROM games WHERE platform_count >= 3)",
)
def cascade_delete(spark, d):
    gone = fx.games(spark, d).filter("platform_count >= 3")
    return maintenance.cascade_delete(fx.sources(spark, d), gone).select("url")


@query("purge_domain", with_ctes("sources") + "SELECT url FROM sources WHERE domain <> 's5.example.com'")
def purge_domain(spark, d):
    return maintenance.purge_domain(fx.sources(spark, d), "s5.example.com").select("url")


@query("purge_since", _LATE + "SELECT url FROM kept")
def purge_since(spark, d):
    return _late_sources(spark, d).select("url")


_OLD_LOG = f"checked_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY"


@query("log_retention", with_ctes("logs") + f"SELECT id, domain FROM logs WHERE NOT ({_OLD_LOG})")
def log_retention(spark, d):
    return maintenance.retain_logs(fx.logs(spark, d), fx.at(EVENTS_AS_OF), 7)[0].select("id", "domain")


@query("log_retention_count", with_ctes("logs") + f"SELECT count(*) AS deleted FROM logs WHERE {_OLD_LOG}")
def log_retention_count(spark, d):
    return maintenance.retain_logs(fx.logs(spark, d), fx.at(EVENTS_AS_OF), 7)[1]


# --- feeds -----------------------------------------------------------------


def _adds(spark, d):
    """A feed per nation of the customers and one per supplier nation: some are known, some repeat."""
    nations = fx.table(spark, d, "customer").select(F.concat(F.lit("https://s"), F.col("c_nationkey").cast("string")).alias("u"))
    others = fx.table(spark, d, "supplier").select(F.concat(F.lit("https://new"), F.col("s_nationkey").cast("string")).alias("u"))
    return nations.unionByName(others).select(F.concat("u", F.lit(".example.com/sitemap.xml")).alias("url"))


_ADDS = (
    with_ctes("feeds").rstrip()
    + """, adds AS (SELECT 'https://s' || c_nationkey || '.example.com/sitemap.xml' AS url FROM customer
  UNION ALL SELECT 'https://new' || s_nationkey || '.example.com/sitemap.xml' FROM supplier)
"""
)


def _now():
    return fx.at("2024-02-01 00:00:00")



def _feed_rows(df):
    return df.select("id", "url", "domain", second("created_at").alias("created_at"), second("updated_at").alias("updated_at")).fillna(
        "none", ["created_at"]
    )


_FMT = "'%Y-%m-%d %H:%M:%S'"


@query(
    "feed_upsert",
    _ADDS
    + f"""SELECT md5(coalesce(f.url, a.url)) AS id, coalesce(f.url, a.url) AS url, regexp_extract(coalesce(f.url, a.url), '//([^/]+)', 1) AS domain,
            CASE WHEN f.url IS NOT NULL THEN coalesce(strftime(f.created_at, {_FMT}), 'none') ELSE '2024-02-01 00:00:00' END AS created_at,
            CASE WHEN a.url IS NOT NULL THEN '2024-02-01 00:00:00' ELSE strftime(f.updated_at, {_FMT}) END AS updated_at
          FROM feeds f FULL JOIN (SELECT DISTINCT url FROM adds) a ON a.url = f.url""",
)
def feed_upsert(spark, d):
    return _feed_rows(feeds.upsert_feeds(fx.feeds(spark, d), _adds(spark, d), _now()))


@query(
    "feed_insert",
    _ADDS
    + f"""SELECT id, url, domain, coalesce(strftime(created_at, {_FMT}), 'none') AS created_at, strftime(updated_at, {_FMT}) AS updated_at FROM feeds
          UNION ALL SELECT md5(url), url, regexp_extract(url, '//([^/]+)', 1), '2024-02-01 00:00:00', '2024-02-01 00:00:00'
          FROM (SELECT DISTINCT url FROM adds WHERE url NOT IN (SELECT url FROM feeds))""",
)
def feed_insert(spark, d):
    return _feed_rows(feeds.insert_feeds(fx.feeds(spark, d), _adds(spark, d), _now())[0])


@query(
    "feed_insert_rejects",
    _ADDS
    + """SELECT url, 'duplicate url' AS error, n - CASE WHEN url IN (SELECT url FROM feeds) THEN 0 ELSE 1 END AS rejected
         FROM (SELECT url, count(*) AS n FROM adds GROUP BY url) WHERE n > 1 OR url IN (SELECT url FROM feeds)""",
)
def feed_insert_rejects(spark, d):
    return feeds.insert_feeds(fx.feeds(spark, d), _adds(spark, d), _now())[1]


def _ordered_feeds(spark, d):
    return fx.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("feed_ord"),
        F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.com/sitemap.xml")).alias("url"),
    )


@query(
    "feed_append_outcomes",
    """WITH adds AS (SELECT c_custkey AS add_ord, c_custkey // 3 AS k, 'https://s' || c_custkey // 3 || '.example.com/sitemap.xml' AS url FROM customer),
       tried AS (SELECT *, k % 5 <> 0 AS success, k IN (SELECT s_suppkey FROM supplier) OR add_ord > min(add_ord) OVER (PARTITION BY k) AS listed
                 FROM adds),
       outcomes AS (SELECT *, CASE WHEN NOT success THEN 'failed' WHEN listed THEN 'updated' ELSE 'added' END AS outcome FROM tried)
       SELECT 'outcome' AS part, add_ord AS ord, url, outcome,
         CASE outcome WHEN 'failed' THEN 'HTTP 500' WHEN 'updated' THEN 'known feed updated' ELSE 'added' END AS message FROM outcomes
       UNION ALL SELECT 'list', s_suppkey, 'https://s' || s_suppkey || '.example.com/sitemap.xml', '', '' FROM supplier
       UNION ALL SELECT 'list', (SELECT max(s_suppkey) FROM supplier) + 1 + add_ord, url, '', '' FROM outcomes WHERE outcome = 'added'""",
)
def feed_append_outcomes(spark, d):
    """Every feed is asked for three times; the outcomes and the grown list."""
    k = F.floor(F.col("c_custkey") / 3)
    rows = fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("add_ord"),
        F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.com/sitemap.xml")).alias("url"),
        (k % 5 != 0).alias("success"),
    )
    checks = rows.select("url", "success", F.when(F.col("success"), F.lit("")).otherwise(F.lit("HTTP 500")).alias("error")).distinct()
    grown, outcome = feeds.append_feeds(_ordered_feeds(spark, d), rows.select("add_ord", "url"), checks)
    return outcome.select(F.lit("outcome").alias("part"), F.col("add_ord").alias("ord"), "url", "outcome", "message").unionByName(
        grown.select(F.lit("list").alias("part"), F.col("feed_ord").alias("ord"), "url", F.lit("").alias("outcome"), F.lit("").alias("message"))
    )


@query(
    "feed_remove",
    _ADDS + "SELECT url, 'kept' AS part FROM feeds WHERE url NOT IN (SELECT url FROM adds) UNION ALL SELECT DISTINCT url, 'missing' FROM adds WHERE url NOT IN (SELECT url FROM feeds)",
)
def feed_remove(spark, d):
    kept, missing = feeds.remove_feeds(fx.feeds(spark, d), _adds(spark, d))
    return kept.select("url", F.lit("kept").alias("part")).unionByName(missing.select("url", F.lit("missing").alias("part")))


@query("feed_remove_by_id", _ADDS + "SELECT url FROM feeds WHERE id NOT IN (SELECT md5(url) FROM adds)")
def feed_remove_by_id(spark, d):
    ids = _adds(spark, d).select(F.md5("url").alias("id"))
    return feeds.remove_feeds_by_id(fx.feeds(spark, d), ids).select("url")


_INTAKE = "CASE lang WHEN 'en' THEN 'https://d{0}.example.com/SiteMap.xml' WHEN 'de' THEN 'https://d{0}.example.com/feed.xml' WHEN 'fr' THEN ' ' ELSE 'sitemap of {0}' END"


@query(
    "feed_validate",
    f"""SELECT doc_id, url, CASE WHEN trim(url) = '' THEN 'blank' WHEN NOT starts_with(url, 'https://') THEN 'invalid url'
          WHEN NOT contains(lower(url), 'sitemap') THEN 'not a sitemap' ELSE 'ok' END AS outcome
        FROM (SELECT doc_id, {_INTAKE.format("' || doc_id || '")} AS url FROM documents)""",
)
def feed_validate(spark, d):
    docs = fx.table(spark, d, "documents").selectExpr("doc_id", _INTAKE.format("' || doc_id || '") + " AS url")
    ok, rejects = feeds.validate_feeds(docs)
    return ok.withColumn("outcome", F.lit("ok")).unionByName(rejects.withColumnRenamed("reject_reason", "outcome"))


_LISTED = f"SELECT url, coalesce(strftime(created_at, {_FMT}), 'none') AS created_at, {{place}} FROM feeds"


@query("feed_list_old_first", with_ctes("feeds") + _LISTED.format(place=_place("feeds.created_at ASC NULLS LAST, url")))
def feed_list_old_first(spark, d):
    rows = placed(feeds.list_feeds(fx.feeds(spark, d)))
    return rows.select("url", second("created_at").alias("created_at"), "place").fillna("none", ["created_at"])


@query("feed_list_new_first", with_ctes("feeds") + _LISTED.format(place=_place("feeds.created_at DESC NULLS FIRST, url")))
def feed_list_new_first(spark, d):
    rows = placed(feeds.list_feeds(fx.feeds(spark, d), newest_first=True))
    return rows.select("url", second("created_at").alias("created_at"), "place").fillna("none", ["created_at"])


@query(
    "feed_order",
    with_ctes("feeds")
    + "SELECT url, row_number() OVER (ORDER BY created_at NULLS LAST, url) - 1 AS feed_ord FROM feeds",
)
def feed_order(spark, d):
    return feeds.feed_order(fx.feeds(spark, d)).select("url", "feed_ord")


@query(
    "feed_cards",
    with_ctes("feeds")
    + "SELECT url, domain, coalesce(strftime(created_at, '%Y-%m-%d'), 'none') AS added_on, strftime(updated_at, '%Y-%m-%d') AS updated_on FROM feeds",
)
def feed_cards(spark, d):
    return _dated(feeds.feed_card(fx.feeds(spark, d)), "added_on", "updated_on").fillna("none", ["added_on"])


@query("capped_feeds", with_ctes("feeds") + "SELECT url FROM feeds ORDER BY created_at NULLS LAST, url LIMIT 15")
def capped_feeds(spark, d):
    return feeds.cap_feeds(fx.feeds(spark, d), 15)[0].select("url")


@query("skipped_feeds", with_ctes("feeds") + "SELECT count(*) AS total, greatest(count(*) - 15, 0) AS skipped FROM feeds")
def skipped_feeds(spark, d):
    return feeds.cap_feeds(fx.feeds(spark, d), 15)[1]


@query(
    "distinct_domains",
    with_ctes("feeds")
    + """SELECT domain, row_number() OVER (ORDER BY max(coalesce(created_at, TIMESTAMP '9999-12-31')) DESC, domain) AS place
         FROM feeds GROUP BY domain""",
)
def distinct_domains(spark, d):
    return placed(feeds.distinct_domains(fx.feeds(spark, d))).select("domain", "place")


@query("feed_count", with_ctes("feeds") + "SELECT count(*) AS feeds FROM feeds")
def feed_count(spark, d):
    return feeds.feed_count(fx.feeds(spark, d))
