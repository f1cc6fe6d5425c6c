"""Queries over snapshots and the registry."""

from pyspark.sql import functions as F

from ..operators import diff, feeds, guards, maintenance, registry, reports, snapshots
from ..operators.extract import extract_entities, extract_urls
from ..plans.full_run import forced_run
from ..session import cut_lineage
from . import fixtures as fx
from .fixtures import with_ctes
from .registry import query

_URL_COLS = ["feed_ord", "domain", "pos", "url"]
_AT = "2024-01-05 08:00:00"


def _diff_listings(spark, d):
    return diff.diff_urls(fx.new_listings(spark, d), fx.old_listings(spark, d))


def _diff_stores(spark, d):
    return diff.diff_urls(fx.new_stores(spark, d), fx.old_stores(spark, d))


# --- diffs -----------------------------------------------------------------


@query(
    "new_urls_per_domain",
    with_ctes("diff_listings") + "SELECT domain, count(*) AS total_new FROM diff_listings GROUP BY domain",
)
def new_urls_per_domain(spark, d):
    return _diff_listings(spark, d).groupBy("domain").agg(F.count("*").alias("total_new")).orderBy(F.desc("total_new"))


@query(
    "url_diff_keep_duplicates",
    with_ctes("diff_listings")
    + "SELECT domain, pos, url FROM diff_listings UNION ALL SELECT domain, pos, url FROM diff_listings",
)
def url_diff_keep_duplicates(spark, d):
    new = fx.new_listings(spark, d).select("domain", "pos", "url")
    return diff.diff_urls(new.unionAll(new), fx.old_listings(spark, d))


_LENIENT_URLS = r"""
lenient AS (SELECT feed_ord, domain, status, CAST(i - 1 AS BIGINT) AS pos, urls[i] AS url FROM
  (SELECT *, unnest(range(1, len(urls) + 1)) AS i FROM (
    SELECT *, list_filter(list_transform(regexp_extract_all(content, '(?i)<loc[^>]*>([^\n\r]*?)</loc>', 1), lambda u: trim(u)),
      lambda u: starts_with(u, 'http://') OR starts_with(u, 'https://')) AS urls FROM page_docs)))
"""


@query(
    "url_diff_lenient",
    with_ctes("page_docs").rstrip()
    + ","
    + _LENIENT_URLS
    + """SELECT feed_ord, domain, pos, url FROM lenient n WHERE status = 200 AND NOT EXISTS
           (SELECT 1 FROM lenient o WHERE o.status = 404 AND o.domain = n.domain AND o.url = n.url)""",
)
def url_diff_lenient(spark, d):
    docs = fx.page_docs(spark, d)
    rows = diff.compare_documents(docs.filter("status = 200"), docs.filter("status = 404"))
    return rows.select("feed_ord", "domain", F.col("pos").cast("bigint").alias("pos"), "url")


@query(
    "known_urls",
    with_ctes("new_listings", "old_sources")
    + "SELECT domain, pos, url FROM new_listings WHERE url IN (SELECT url FROM old_sources)",
)
def known_urls(spark, d):
    sources = fx.sources_of(fx.old_listings(spark, d))
    return diff.known_urls(fx.new_listings(spark, d), sources).select("domain", "pos", "url")


# --- guards ----------------------------------------------------------------

_STATUS = """CASE WHEN {c} = 0 THEN 'zero' WHEN {b} IS NULL AND {c} < 10 THEN 'first_small' WHEN {b} IS NULL THEN 'first_ok'
  WHEN {c} < {b} * 0.5 THEN 'shrunk' ELSE 'ok' END"""
_CLASSES = f"""
counts AS (SELECT domain, CAST(sum(n) AS BIGINT) AS new_count, CAST(nullif(sum(o), 0) AS BIGINT) AS old_count FROM
  (SELECT domain, 1 AS n, 0 AS o FROM new_stores UNION ALL SELECT domain, 0, 1 FROM old_stores) GROUP BY domain),
classes AS (SELECT *, {_STATUS.format(c="new_count", b="old_count")} AS status FROM counts)
"""


@query(
    "guard_classes",
    with_ctes("new_stores", "old_stores").rstrip()
    + ","
    + _CLASSES
    + """SELECT domain, coalesce(old_count, -1) AS old_count, new_count, status, CASE status WHEN 'zero' THEN 'no URL found in the document'
           WHEN 'first_small' THEN 'too few URLs in first check: ' || new_count
           WHEN 'shrunk' THEN 'implausible URL count: new=' || new_count || ', old=' || old_count ELSE '' END AS error
         FROM classes""",
)
def guard_classes(spark, d):
    return guards.classify_checks(fx.new_stores(spark, d), fx.old_stores(spark, d)).fillna(-1, ["old_count"])


def walk(rows: str, initial: str) -> str:
    """SQL that visits the checks of each domain in order; `rows(domain, run, c)`."""
    accepted = "w.c > 0 AND ((w.b IS NULL AND w.c >= 10) OR w.c >= w.b * 0.5)"
    return f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY run) AS rn FROM ({rows})),
walk(domain, rn, run, c, b, bf) AS (
  SELECT n.domain, n.rn, n.run, n.c, i.b, CASE WHEN i.b IS NOT NULL THEN -1 END
  FROM numbered n LEFT JOIN ({initial}) i ON i.domain = n.domain WHERE n.rn = 1
  UNION ALL
  SELECT n.domain, n.rn, n.run, n.c, CASE WHEN {accepted} THEN w.c ELSE w.b END, CASE WHEN {accepted} THEN w.run ELSE w.bf END
  FROM walk w JOIN numbered n ON n.domain = w.domain AND n.rn = w.rn + 1),
folded AS (SELECT domain, run, CAST(c AS BIGINT) AS c, CAST(b AS BIGINT) AS b, CAST(bf AS BIGINT) AS bf,
  {_STATUS.format(c="c", b="b")} AS status FROM walk)
"""


HISTORY_WALK = (
    with_ctes("history").rstrip()
    + ","
    + walk("SELECT domain, run, url_count AS c FROM history", "SELECT NULL AS domain, CAST(NULL AS BIGINT) AS b")
    + """SELECT domain, run, c AS url_count, coalesce(b, -1) AS baseline, coalesce(bf, -2) AS baseline_run, status,
           status IN ('ok', 'first_ok') AS accepted FROM folded"""
)


@query("accepted_baseline", HISTORY_WALK)
def accepted_baseline(spark, d):
    return show_baseline(guards.accepted_baseline(fx.history(spark, d)))


def show_baseline(rows):
    """No baseline is shown as -1 and -2, so that both engines give integer columns."""
    return rows.fillna(-1, ["baseline"]).fillna(-2, ["baseline_run"])


# --- snapshot check --------------------------------------------------------


def stored_snapshot(spark, d):
    """The first failed page of a site stands for its stored catalog."""
    docs = fx.page_docs(spark, d).filter("status = 404")
    first = docs.groupBy("domain").agg(F.min("feed_ord").alias("feed_ord"))
    urls = extract_urls(docs.join(first, ["domain", "feed_ord"])).select(
        "domain", F.col("pos").cast("bigint").alias("pos"), "url"
    )
    headers = urls.groupBy("domain").agg(F.count("*").alias("url_count"))
    return headers.select(
        "domain", F.lit(0).cast("bigint").alias("gen"), "url_count", F.lit("2024-01-01").cast("timestamp").alias("updated_at")
    ), urls


def _check(spark, d):
    headers, urls = stored_snapshot(spark, d)
    return snapshots.snapshot_check(fx.page_docs(spark, d), headers, urls, _AT, gen=1)


CHECK = (
    with_ctes("page_urls").rstrip()
    + """,
first_failed AS (SELECT domain, min(feed_ord) AS feed_ord FROM page_docs WHERE status = 404 GROUP BY domain),
stored AS (SELECT u.* FROM page_urls u JOIN first_failed f ON f.domain = u.domain AND f.feed_ord = u.feed_ord),"""
    + walk(
        """SELECT p.domain, p.feed_ord AS run, count(u.url) AS c FROM page_docs p LEFT JOIN page_urls u ON u.feed_ord = p.feed_ord
           WHERE p.status = 200 GROUP BY p.domain, p.feed_ord""",
        "SELECT domain, count(*) AS b FROM stored GROUP BY domain",
    )
)
CHECK_DIFF = """
compared AS (SELECT u.*, f.bf FROM page_urls u JOIN folded f ON f.domain = u.domain AND f.run = u.feed_ord WHERE f.status = 'ok'),
diff AS (SELECT feed_ord, domain, pos, url FROM compared n WHERE NOT EXISTS (SELECT 1 FROM stored o
    WHERE n.bf = -1 AND o.domain = n.domain AND o.url = n.url)
  AND NOT EXISTS (SELECT 1 FROM page_urls o WHERE o.feed_ord = n.bf AND o.domain = n.domain AND o.url = n.url))
"""


@query(
    "snapshot_check",
    CHECK.rstrip()
    + ","
    + CHECK_DIFF
    + """SELECT p.feed_ord, p.domain, coalesce(f.status, 'fetch_error') AS check_status,
           coalesce(f.status IN ('ok', 'first_ok'), false) AS success, CASE WHEN f.status IS NULL THEN 'HTTP 404'
             WHEN f.status = 'shrunk' THEN 'implausible URL count: new=' || c || ', old=' || b
             WHEN f.status = 'first_small' THEN 'too few URLs in first check: ' || c ELSE '' END AS error,
           coalesce(f.b, -1) AS baseline, coalesce(f.c, 0) AS total_urls,
           (SELECT count(*) FROM diff x WHERE x.feed_ord = p.feed_ord) AS new_urls
         FROM page_docs p LEFT JOIN folded f ON f.run = p.feed_ord""",
)
def snapshot_check(spark, d):
    result = _check(spark, d)
    return snapshots.with_new_counts(result.checks, result.diff).drop("feed_url").fillna(-1, ["baseline"])


@query("snapshot_check_diff", CHECK.rstrip() + "," + CHECK_DIFF + "SELECT * FROM diff")
def snapshot_check_diff(spark, d):
    return _check(spark, d).diff


_WINNERS = """
winners AS (SELECT domain, max(run) AS run FROM folded WHERE status IN ('ok', 'first_ok') GROUP BY domain),
next AS (SELECT domain, pos, url FROM stored WHERE domain NOT IN (SELECT domain FROM winners)
  UNION ALL SELECT u.domain, u.pos, u.url FROM page_urls u JOIN winners w ON w.domain = u.domain AND w.run = u.feed_ord)
"""


@query("snapshot_check_urls", CHECK.rstrip() + "," + _WINNERS + "SELECT * FROM next")
def snapshot_check_urls(spark, d):
    return _check(spark, d).snapshot_urls


@query(
    "snapshot_check_headers",
    CHECK.rstrip()
    + ","
    + _WINNERS
    + """SELECT domain, count(*) AS url_count, CASE WHEN domain IN (SELECT domain FROM winners) THEN 1::BIGINT ELSE 0::BIGINT END AS gen
         FROM next GROUP BY domain""",
)
def snapshot_check_headers(spark, d):
    return _check(spark, d).snapshots.select("domain", "url_count", "gen")


# --- daily rule ------------------------------------------------------------


def _state(spark, d):
    """First and last failed page of a site as current and latest document; blogs were updated today."""
    docs = fx.page_docs(spark, d).filter("status = 404")
    both = docs.groupBy("domain").agg(
        F.min_by("content", "feed_ord").alias("current"),
        F.max_by("content", "feed_ord").alias("last"),
        (F.min("feed_ord") < F.max("feed_ord")).alias("two"),
    )
    return both.select(
        "domain",
        "current",
        F.when(F.col("two"), F.col("last")).alias("latest"),
        F.when(F.col("domain").startswith("blog."), "20240105").otherwise("20240104").alias("last_update"),
    )


_DAILY = (
    with_ctes("page_docs").rstrip()
    + ","
    + _LENIENT_URLS.rstrip()
    + """,
state AS (SELECT domain, min(feed_ord) AS cur, CASE WHEN min(feed_ord) < max(feed_ord) THEN max(feed_ord) END AS lat,
  starts_with(domain, 'blog.') AS today FROM page_docs WHERE status = 404 GROUP BY domain),
feeds AS (SELECT p.feed_ord, p.domain, p.status = 200 AS ok, s.cur, s.lat, coalesce(s.today, false) AS today,
  min(CASE WHEN p.status = 200 THEN p.feed_ord END) OVER (PARTITION BY p.domain) AS first_ok
  FROM page_docs p LEFT JOIN state s ON s.domain = p.domain),
"""
)
_UNFORCED = """
refs AS (SELECT *, CASE WHEN today THEN 'today' WHEN feed_ord = first_ok THEN 'first' WHEN feed_ord > first_ok THEN 'later' END AS kind,
  CASE WHEN today THEN cur WHEN feed_ord = first_ok THEN feed_ord WHEN feed_ord > first_ok THEN first_ok END AS l,
  CASE WHEN today THEN lat WHEN feed_ord = first_ok THEN cur WHEN feed_ord > first_ok THEN coalesce(cur, lat) END AS r FROM feeds)
"""
_FORCED = """
refs AS (SELECT feed_ord, domain, 'forced' AS kind, feed_ord AS l,
  coalesce(lag(feed_ord) OVER (PARTITION BY domain ORDER BY feed_ord), cur) AS r FROM feeds WHERE ok)
"""
_PAIRS = """SELECT f.feed_ord, f.domain, n.pos, n.url FROM refs f JOIN lenient n ON n.feed_ord = f.l
  WHERE f.r IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lenient o WHERE o.feed_ord = f.r AND o.url = n.url)"""


@query(
    "same_day_outcomes",
    _DAILY
    + _UNFORCED
    + """SELECT feed_ord, domain, kind IS NOT NULL AS success, CASE WHEN kind = 'first' THEN 'fetched'
           WHEN kind IS NULL THEN 'fetch_error' WHEN l IS NOT NULL AND r IS NOT NULL THEN 'same_day_news' ELSE 'same_day' END AS outcome,
           CASE WHEN kind IS NULL THEN 'HTTP 404' ELSE '' END AS error FROM refs""",
)
def same_day_outcomes(spark, d):
    return snapshots.daily_check(fx.page_docs(spark, d), _state(spark, d), _AT).checks.drop("feed_url")


@query("same_day_recheck", _DAILY + _UNFORCED + _PAIRS)
def same_day_recheck(spark, d):
    return snapshots.daily_check(fx.page_docs(spark, d), _state(spark, d), _AT).diff


@query("forced_recheck", _DAILY + _FORCED + _PAIRS)
def forced_recheck(spark, d):
    return snapshots.daily_check(fx.page_docs(spark, d), _state(spark, d), _AT, force=True).diff


@query(
    "forced_run_domains",
    _DAILY
    + _FORCED.rstrip()
    + f""", diff AS ({_PAIRS}), totals AS (SELECT domain, count(*) AS total_new FROM diff GROUP BY domain),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY feed_ord, pos) AS k FROM diff) WHERE k <= 3)
SELECT t.domain, t.total_new, string_agg(f.url, ' ' ORDER BY f.k) AS samples, greatest(t.total_new - 3, 0) AS remaining
FROM totals t JOIN firsts f ON f.domain = t.domain GROUP BY t.domain, t.total_new""",
)
def forced_run_domains(spark, d):
    _, report = forced_run(fx.page_docs(spark, d), _state(spark, d), _AT)
    return report["domains"].select("domain", "total_new", F.array_join("samples", " ").alias("samples"), "remaining")


# Hashes stand for the documents; the dated copies are rows of their own.
@query(
    "snapshot_rotation",
    with_ctes("page_docs")
    + """, docs AS (SELECT domain, status, content, feed_ord FROM page_docs),
old AS (SELECT domain, arg_min(content, feed_ord) AS current FROM docs WHERE status = 404 GROUP BY domain),
new AS (SELECT domain, arg_max(content, feed_ord) AS content FROM docs WHERE status = 200 GROUP BY domain)
SELECT coalesce(o.domain, n.domain) AS domain, md5(CASE WHEN n.domain IS NOT NULL THEN n.content ELSE o.current END) AS current,
  coalesce(md5(CASE WHEN n.domain IS NOT NULL THEN o.current END), '-') AS latest,
  CASE WHEN n.domain IS NOT NULL THEN '20240105' ELSE '20240104' END AS last_update, 'state' AS part
FROM old o FULL JOIN new n ON n.domain = o.domain
UNION ALL SELECT domain, md5(content), '-', '20240105', 'dated' FROM new""",
)
def snapshot_rotation(spark, d):
    docs = fx.page_docs(spark, d)
    old = docs.filter("status = 404").groupBy("domain").agg(F.min_by("content", "feed_ord").alias("current"))
    old = old.select("domain", "current", F.lit(None).cast("string").alias("latest"), F.lit("20240104").alias("last_update"))
    new = docs.filter("status = 200").groupBy("domain").agg(F.max_by("content", "feed_ord").alias("content"))
    state, dated = snapshots.rotate_snapshots(old, new, _AT)
    none = F.lit("-")
    slots = state.select(
        "domain",
        F.md5("current").alias("current"),
        F.coalesce(F.md5("latest"), none).alias("latest"),
        "last_update",
        F.lit("state").alias("part"),
    )
    copies = dated.select(
        "domain", F.md5("content").alias("current"), none.alias("latest"), F.col("date").alias("last_update"), F.lit("dated").alias("part")
    )
    return slots.unionByName(copies)


@query(
    "snapshot_lookup",
    "SELECT l.doc_id, CASE WHEN l.toxic = 0 THEN d.text ELSE 'none' END AS content FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id",
)
def snapshot_lookup(spark, d):
    """Toxic documents were emptied; they count as absent."""
    labels = fx.table(spark, d, "labels").select(F.col("doc_id").alias("domain"), "toxic")
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("domain"), "text")
    stored = docs.join(labels, "domain", "left").select(
        "domain", F.when(F.coalesce("toxic", F.lit(0)) == 0, F.col("text")).otherwise("").alias("content")
    )
    found = snapshots.lookup_snapshot(labels.select("domain"), stored)
    return found.select(F.col("domain").alias("doc_id"), "content").fillna("none", ["content"])


@query(
    "snapshot_upsert",
    with_ctes("new_stores", "old_stores")
    + """, o AS (SELECT domain, count(*) AS url_count FROM old_stores GROUP BY domain),
n AS (SELECT domain, count(*) AS url_count FROM new_stores GROUP BY domain)
SELECT coalesce(n.domain, o.domain) AS domain, coalesce(n.url_count, o.url_count) AS url_count,
  CASE WHEN n.domain IS NULL THEN 0::BIGINT ELSE 1::BIGINT END AS gen FROM o FULL JOIN n ON n.domain = o.domain""",
)
def snapshot_upsert(spark, d):
    def headers(rows, gen):
        return rows.groupBy("domain").agg(F.count("*").alias("url_count")).withColumn("gen", F.lit(gen).cast("bigint"))

    return snapshots.upsert_snapshots(headers(fx.old_stores(spark, d), 0), headers(fx.new_stores(spark, d), 1))


@query(
    "snapshot_by_kind",
    """SELECT user_id, event_id FROM events WHERE event_type = 'view' AND strftime(ts, '%Y%m%d') = '20240115'
       UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'click'""",
)
def snapshot_by_kind(spark, d):
    """Views stand for dated copies, clicks for current documents, others for latest ones."""
    kind = F.when(F.col("event_type") == "view", "dated").when(F.col("event_type") == "click", "current").otherwise("latest")
    rows = fx.table(spark, d, "events").select(
        "user_id", "event_id", kind.alias("kind"), F.date_format("ts", "yyyyMMdd").alias("date")
    )
    dated = snapshots.lookup_by_kind(rows, "dated", as_of="2024-01-15 10:00:00")
    return dated.unionByName(snapshots.lookup_by_kind(rows, "current")).select("user_id", "event_id")


# --- registry --------------------------------------------------------------


def _candidates(spark, d):
    return extract_entities(_diff_listings(spark, d).select(*_URL_COLS))


def _registry(spark, d):
    """The registry of the old listings."""
    return fx.registry(spark, d, fx.LISTED_BEFORE)


def _upsert(spark, d):
    games, sources = _registry(spark, d)
    return registry.upsert_entities(_candidates(spark, d), games, sources, fx.at("2024-01-05"))


_UPSERT = (
    with_ctes("diff_listings", "old_games", "old_sources").rstrip()
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY clean_name, domain ORDER BY feed_ord, pos, url) AS k FROM diff_listings n
  WHERE NOT EXISTS (SELECT 1 FROM old_sources s WHERE s.game_id = md5(n.clean_name) AND s.domain = n.domain)),
accepted AS (SELECT *, row_number() OVER (PARTITION BY clean_name ORDER BY feed_ord, pos, url) AS r FROM ranked WHERE k = 1),
changes AS (SELECT a.feed_ord, a.pos, a.domain, a.url, a.name, a.clean_name, g.id IS NULL AND r = 1 AS is_new,
  NOT (g.id IS NULL AND r = 1) AS is_cross,
  CASE WHEN g.id IS NULL AND r = 1 THEN -1 ELSE coalesce(g.platform_count, 0) + r - 1 END AS platform_count
  FROM accepted a LEFT JOIN old_games g ON g.clean_name = a.clean_name)
"""
)


@query("entity_changes", _UPSERT + "SELECT * FROM changes")
def entity_changes(spark, d):
    return _upsert(spark, d).changes.fillna(-1, ["platform_count"])


@query(
    "feed_add_checked",
    _UPSERT
    + """, asked AS (SELECT *, s_suppkey % 2 = 0 AS known, s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AS good,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(s_suppkey AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS created FROM supplier)
SELECT 'feed' AS part, 'https://s' || s_suppkey || '.example.com/sitemap.xml' AS url,
  CASE WHEN NOT known THEN '2024-02-01 00:00:00' WHEN s_acctbal >= 0 THEN created ELSE 'none' END AS created_at,
  CASE WHEN good THEN '2024-02-01 00:00:00' ELSE created END AS updated_at FROM asked WHERE known OR good
UNION ALL SELECT 'new_url', url, '', '' FROM changes JOIN asked ON s_suppkey = feed_ord WHERE good AND is_new""",
)
def feed_add_checked(spark, d):
    """Half of the sites are listed; two thirds are added, and a quarter of all checks fail."""
    all_feeds = fx.feeds(spark, d)
    k = F.regexp_extract("url", "//s([0-9]+)", 1).cast("bigint")
    stored, adds = all_feeds.filter(k % 2 == 0), all_feeds.filter(k % 3 != 0).select("url")
    checks = all_feeds.select(k.alias("feed_ord"), F.col("url").alias("feed_url"), (k % 4 != 0).alias("success"))
    grown, urls = feeds.add_checked(stored, adds, checks, _upsert(spark, d).changes, fx.at("2024-02-01"))
    rows = grown.select(F.lit("feed").alias("part"), "url", fx.second("created_at").alias("created_at"), fx.second("updated_at").alias("updated_at"))
    shown = urls.select(F.lit("new_url").alias("part"), "url", F.lit("").alias("created_at"), F.lit("").alias("updated_at"))
    return rows.fillna("none", ["created_at"]).unionByName(shown)


@query(
    "entity_registry",
    _UPSERT
    + """, held AS (SELECT clean_name, domain FROM old_listings UNION SELECT clean_name, domain FROM accepted),
firsts AS (SELECT name, clean_name FROM accepted WHERE r = 1)
SELECT h.clean_name, coalesce(any_value(g.name), any_value(f.name)) AS name, CAST(count(DISTINCT h.domain) AS INTEGER) AS platform_count,
  1.0::DOUBLE + least(count(DISTINCT h.domain) - 1, 3) * 0.5::DOUBLE AS score
FROM held h LEFT JOIN old_games g ON g.clean_name = h.clean_name LEFT JOIN firsts f ON f.clean_name = h.clean_name
GROUP BY h.clean_name""",
)
def entity_registry(spark, d):
    return _upsert(spark, d).games.select("clean_name", "name", "platform_count", F.col("score").cast("double").alias("score"))


@query(
    "registry_sources",
    _UPSERT
    + """SELECT id, game_id, domain, url FROM old_sources UNION ALL
         SELECT md5(url), md5(clean_name), domain, url FROM accepted""",
)
def registry_sources(spark, d):
    return _upsert(spark, d).sources.select("id", "game_id", "domain", "url")


def _shared_candidates(spark, d):
    """All line items; an entity has one URL for open and one for closed items, whatever the site."""
    url = F.concat(F.when(F.col("is_open"), F.lit("https://a")).otherwise(F.lit("https://b")), F.lit(".example.com/games/"), "name")
    return extract_entities(fx.listings(spark, d).select("feed_ord", "domain", "pos", url.alias("url")))


@query(
    "entity_changes_shared_urls",
    with_ctes("listings")
    + """, c AS (SELECT feed_ord, pos, domain, name, clean_name,
  CASE WHEN is_open THEN 'https://a' ELSE 'https://b' END || '.example.com/games/' || name AS url FROM listings),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clean_name ORDER BY feed_ord, pos, url) AS k FROM c) WHERE k = 1),
two AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.clean_name ORDER BY c.feed_ord, c.pos, c.url) AS k
  FROM c JOIN one o ON o.clean_name = c.clean_name WHERE c.url <> o.url AND c.domain <> o.domain) WHERE k = 1)
SELECT c.feed_ord, c.pos, c.domain, c.url, c.name, c.clean_name, x.is_new, NOT x.is_new AS is_cross,
  CASE WHEN NOT x.is_new THEN 1::BIGINT + x.after_two ELSE -1 END AS platform_count
FROM (SELECT c.*, (c.feed_ord, c.pos, c.url) = (o.feed_ord, o.pos, o.url) AS is_new,
    CASE WHEN t.url IS NOT NULL AND (c.feed_ord, c.pos, c.url) > (t.feed_ord, t.pos, t.url) THEN 1 ELSE 0 END AS after_two,
    (c.domain = o.domain AND (c.feed_ord, c.pos, c.url) > (o.feed_ord, o.pos, o.url))
      OR coalesce(c.domain = t.domain AND (c.feed_ord, c.pos, c.url) > (t.feed_ord, t.pos, t.url), false) AS held
  FROM c JOIN one o ON o.clean_name = c.clean_name LEFT JOIN two t ON t.clean_name = c.clean_name) x
JOIN c ON (c.feed_ord, c.pos, c.url, c.domain) = (x.feed_ord, x.pos, x.url, x.domain) WHERE NOT x.held""",
)
def entity_changes_shared_urls(spark, d):
    empty = fx.listings(spark, d).filter(F.lit(False))
    return registry.upsert_entities(
        _shared_candidates(spark, d), fx.games_of(empty), fx.sources_of(empty), fx.at("2024-01-05")
    ).changes.fillna(-1, ["platform_count"])


@query(
    "games_insert",
    with_ctes("new_listings", "old_games")
    + """SELECT md5(clean_name) AS id, name, clean_name FROM (SELECT *, row_number() OVER
           (PARTITION BY clean_name ORDER BY feed_ord, pos, url) AS k FROM new_listings) WHERE k = 1
         AND clean_name NOT IN (SELECT clean_name FROM old_games)""",
)
def games_insert(spark, d):
    games = fx.games_of(fx.old_listings(spark, d))
    return registry.insert_games(fx.new_listings(spark, d), games, fx.at("2024-01-05")).select("id", "name", "clean_name")


@query("sources_insert", _UPSERT + "SELECT md5(url) AS id, md5(clean_name) AS game_id, domain, url FROM accepted")
def sources_insert(spark, d):
    games, sources = _registry(spark, d)
    rows = registry.insert_sources(_candidates(spark, d), games, sources, fx.at("2024-01-05"))
    return rows.select("id", "game_id", "domain", "url")


@query(
    "game_lookup",
    with_ctes("new_listings", "old_games")
    + "SELECT n.domain, n.pos, n.clean_name, coalesce(g.id, 'none') AS game_id FROM new_listings n LEFT JOIN old_games g ON g.clean_name = n.clean_name",
)
def game_lookup(spark, d):
    games = fx.games_of(fx.old_listings(spark, d))
    rows = registry.lookup_games(fx.new_listings(spark, d), games)
    return rows.select("domain", "pos", "clean_name", "game_id").fillna("none", ["game_id"])


@query(
    "missing_platforms",
    with_ctes("new_listings", "old_games", "old_sources")
    + """SELECT n.domain, n.pos, n.clean_name, g.id AS game_id FROM new_listings n JOIN old_games g ON g.clean_name = n.clean_name
         WHERE NOT EXISTS (SELECT 1 FROM old_sources s WHERE s.game_id = g.id AND s.domain = n.domain)""",
)
def missing_platforms(spark, d):
    old = fx.old_listings(spark, d)
    known = registry.lookup_games(fx.new_listings(spark, d), fx.games_of(old)).filter("game_id is not null")
    return registry.missing_platforms(known, fx.sources_of(old)).select("domain", "pos", "clean_name", "game_id")


@query(
    "platform_scores",
    with_ctes("sources")
    + """SELECT game_id, CAST(count(DISTINCT domain) AS INTEGER) AS platform_count,
           1.0::DOUBLE + least(count(DISTINCT domain) - 1, 3) * 0.5::DOUBLE AS score FROM sources GROUP BY game_id""",
)
def platform_scores(spark, d):
    counts = registry.platform_counts(fx.sources(spark, d))
    return counts.withColumn("score", registry.score(F.col("platform_count")).cast("double"))


@query("score_histogram", with_ctes("games") + "SELECT score, count(*) AS games FROM games GROUP BY score")
def score_histogram(spark, d):
    games = fx.games(spark, d).select(F.col("score").cast("double").alias("score"))
    return games.groupBy("score").agg(F.count("*").alias("games"))


@query(
    "registry_refresh",
    with_ctes("games", "sources")
    + """SELECT g.clean_name, CAST(count(DISTINCT s.domain) AS INTEGER) AS platform_count,
           1.0::DOUBLE + least(count(DISTINCT s.domain) - 1, 3) * 0.5::DOUBLE AS score
         FROM games g LEFT JOIN sources s ON s.game_id = g.id AND s.domain <> 's7.example.com' GROUP BY g.clean_name""",
)
def registry_refresh(spark, d):
    left = maintenance.purge_domain(fx.sources(spark, d), "s7.example.com")
    games = registry.refresh_stats(fx.games(spark, d), left, fx.at("2024-01-05"))
    return games.select("clean_name", "platform_count", F.col("score").cast("double").alias("score"))


@query(
    "update_log_rows",
    _UPSERT
    + """SELECT domain, feed_ord * 2 + pos % 2 AS feed_ord, count(*) AS new_games_count FROM changes
         GROUP BY domain, feed_ord * 2 + pos % 2""",
)
def update_log_rows(spark, d):
    """Every domain has two feeds here: the even and the odd places of its list."""
    changes = _upsert(spark, d).changes.withColumn("feed_ord", F.col("feed_ord") * 2 + F.col("pos") % 2)
    return registry.log_rows(changes, fx.at("2024-01-05")).select("domain", "feed_ord", "new_games_count")


@query("update_log_items", _UPSERT + "SELECT feed_ord, pos, name, url, is_cross, platform_count FROM changes")
def update_log_items(spark, d):
    return registry.log_items(_upsert(spark, d).changes, fx.at("2024-01-05")).drop("log_id").fillna(-1, ["platform_count"])


@query(
    "new_cross_by_domain",
    _UPSERT
    + """SELECT domain, count(*) FILTER (is_new) AS new_games, count(*) FILTER (is_cross) AS cross_platform
         FROM changes GROUP BY domain""",
)
def new_cross_by_domain(spark, d):
    return reports.changes_by_domain(_upsert(spark, d).changes)


@query("all_changes", _UPSERT + "SELECT domain, url, CASE WHEN is_new THEN 0 ELSE 1 END AS part FROM changes")
def all_changes(spark, d):
    # Both parts read the written changes, which are then computed once.
    changes = cut_lineage(_upsert(spark, d).changes.select("domain", "url", "is_new", "is_cross"))
    return registry.all_changes(changes.filter("is_new"), changes.filter("is_cross")).select("domain", "url", "part")


@query(
    "first_occurrences",
    with_ctes("listings")
    + """SELECT clean_name, domain, feed_ord, pos, url FROM (SELECT *, row_number() OVER
           (PARTITION BY clean_name, domain ORDER BY feed_ord, pos, url) AS k FROM listings) WHERE k = 1""",
)
def first_occurrences(spark, d):
    keys = ["clean_name", "domain"]
    n = fx.tasks(spark.read.parquet(f"{d}/lineitem.parquet"), fx.TASK_ROWS["lineitem"])
    # Dealt by the keys, so that the sorts of the minima hold about as many rows however many there are.
    rows = fx.listings(spark, d).select(*keys, "feed_ord", "pos", "url").repartition(n, *keys)
    return registry.first_per(rows, keys, ["feed_ord", "pos", "url"])
