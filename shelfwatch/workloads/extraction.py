"""Extraction queries."""

from pyspark.sql import functions as F

from ..functions import slugs
from ..functions.urls import url_host, with_url_parts
from ..operators import extract, reports
from ..sources.documents import decode_feed_list
from ..sources.request_logs import request_rows
from . import fixtures as fx
from .fixtures import with_ctes
from .registry import query
from .reporting import placed


@query("extract_urls_strict", with_ctes("page_urls") + "SELECT feed_ord, domain, pos, url FROM page_urls")
def extract_urls_strict(spark, d):
    urls = extract.extract_urls(fx.page_docs(spark, d))
    return urls.select("feed_ord", "domain", F.col("pos").cast("bigint").alias("pos"), "url")


_LENIENT = r"""
SELECT feed_ord, domain, CAST(i - 1 AS BIGINT) AS pos, urls[i] AS url
FROM (SELECT *, unnest(range(1, len(urls) + 1)) AS i FROM (
  SELECT *, list_filter(list_transform(regexp_extract_all(content, '(?i)<loc[^>]*>([^\n\r]*?)</loc>', 1), lambda u: trim(u)),
    lambda u: starts_with(u, 'http://') OR starts_with(u, 'https://')) AS urls FROM page_docs))"""


@query("extract_urls_lenient", with_ctes("page_docs") + _LENIENT)
def extract_urls_lenient(spark, d):
    urls = extract.extract_urls(fx.page_docs(spark, d), "lenient")
    return urls.select("feed_ord", "domain", F.col("pos").cast("bigint").alias("pos"), "url")


@query(
    "urls_with_lastmod",
    with_ctes("page_docs")
    + r"""
SELECT feed_ord, domain, CAST(row_number() OVER (PARTITION BY feed_ord ORDER BY i) - 1 AS BIGINT) AS pos, url, coalesce(lastmod, 'none') AS lastmod FROM (
  SELECT feed_ord, domain, i, trim(regexp_extract(b, '(?i)<loc[^>]*>([^\n\r]*?)</loc>', 1)) AS url,
    CASE WHEN regexp_matches(b, '(?i)<lastmod[^>]*>[^\n\r]*?</lastmod>')
      THEN trim(regexp_extract(b, '(?i)<lastmod[^>]*>([^\n\r]*?)</lastmod>', 1)) END AS lastmod
  FROM (SELECT *, blocks[i] AS b FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM
    (SELECT *, regexp_extract_all(content, '(?is)<url[^>]*>(.*?)</url>', 1) AS blocks FROM page_docs))))
WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')""",
)
def urls_with_lastmod(spark, d):
    rows = extract.extract_urls_with_lastmod(fx.page_docs(spark, d))
    return rows.select("feed_ord", "domain", F.col("pos").cast("bigint").alias("pos"), "url", "lastmod").fillna("none", ["lastmod"])


@query(
    "valid_sitemaps",
    with_ctes("page_docs")
    + r"""
SELECT kind, valid, count(*) AS documents FROM (
  SELECT kind, regexp_matches(content, '(?i)<(urlset|sitemapindex)[^>]*>')
    AND regexp_matches(content, '(?i)<loc[^>]*>[^\n\r]*?</loc>') AS valid
  FROM (SELECT 'catalog' AS kind, content FROM page_docs UNION ALL SELECT 'page', html FROM pages))
GROUP BY kind, valid""",
)
def valid_sitemaps(spark, d):
    docs = fx.page_docs(spark, d).select(F.lit("catalog").alias("kind"), "content")
    docs = docs.unionByName(fx.table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("content")))
    valid, rejected = extract.split_valid_sitemaps(docs)
    both = valid.select("kind", F.lit(True).alias("valid")).unionByName(rejected.select("kind", F.lit(False).alias("valid")))
    return both.groupBy("kind", "valid").agg(F.count("*").alias("documents"))


def _page_urls(spark, d):
    urls = extract.extract_urls(fx.page_docs(spark, d))
    return urls.select("feed_ord", F.col("pos").cast("bigint").alias("pos"), "domain", "url")


@query("page_hosts", with_ctes("page_urls") + "SELECT feed_ord, pos, url, domain AS host FROM page_urls")
def page_hosts(spark, d):
    return with_url_parts(_page_urls(spark, d)).select("feed_ord", "pos", "url", "host")


# Names and their ASCII forms, as the standard's tables give them.
_NAMES = [("bücher", "xn--bcher-kva"), ("faß", "xn--fa-hia"), ("例え", "xn--r8jz45g"), ("почта", "xn--80a1acny"), ("plain", "plain")]
_WRITTEN = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (w, _) in enumerate(_NAMES)) + " END"


@query(
    "standard_hosts",
    f"""SELECT s_suppkey, 's' || s_suppkey || '.' || CASE s_suppkey % 5 {" ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_NAMES))} END
          || '.example' AS named, '10.0.' || s_suppkey // 256 % 256 || '.' || s_suppkey % 256 AS hexadecimal,
          '0.' || s_suppkey // 65536 % 256 || '.' || s_suppkey // 256 % 256 || '.' || s_suppkey % 256 AS number,
          '[2001:db8::' || CASE WHEN s_suppkey % 65536 = 0 THEN '' ELSE lower(hex(s_suppkey % 65536)) END || ']' AS bracketed FROM supplier""",
)
def standard_hosts(spark, d):
    """Every supplier under an international name, as a number, as hexadecimal parts and as a long bracketed address."""
    rows = fx.table(spark, d, "supplier").selectExpr(
        "s_suppkey",
        f"'HTTPS://S' || s_suppkey || '.' || {_WRITTEN} || '.Example:8443/x' AS named",
        "'http://0xA.0.0x' || hex(s_suppkey % 65536) AS hexadecimal",
        "'http://' || s_suppkey % 16777216 || '/x' AS number",
        "'http://[2001:0DB8:0:0:0:0:0:' || hex(s_suppkey % 65536) || ']:80/x' AS bracketed",
    )
    return rows.select("s_suppkey", *[url_host(F.col(c)).alias(c) for c in ("named", "hexadecimal", "number", "bracketed")])


@query("page_paths", with_ctes("page_paths") + "SELECT feed_ord, pos, url, path FROM page_paths")
def page_paths(spark, d):
    return with_url_parts(_page_urls(spark, d)).select("feed_ord", "pos", "url", "path")


# The fixed values are written out here, so that a slip in the operators shows.
_WORDS = """
  'games', 'all-games', 'new-games', 'hot-games', 'popular-games', 'trending-games', 'top-games',
  'featured-games', 'best-games', 'free-games', 'all-tags', 'top-popular', 'action-games',
  'adventure-games', 'puzzle-games', 'racing-games', 'sports-games', 'strategy-games', 'shooting-games',
  'arcade-games', 'casual-games', 'multiplayer-games', 'io-games', 'html5-games', 'girl-games', 'boy-games',
  'kids-games', 'girls-games', 'boys-games', '2-player-games', 'multiplayer', 'single-player', 'about',
  'contact', 'privacy', 'terms', 'faq', 'help', 'support', 'blog', 'news', 'press', 'careers', 'jobs',
  'advertise', 'category', 'categories', 'tag', 'tags', 'genre', 'genres', 'online', 'offline', 'download',
  'downloads', 'login', 'register', 'signup', 'signin', 'search', 'browse', 'index', 'home', 'recents',
  'updated', 'terms-of-service', 'privacy-policy', 'contact-us', 'about-us'
"""
_EXCLUDED = (
    r"(?i)(?:/(tag|tags|category|categories|genre|genres|author|user|profile)/)"
    r"|(?:/(about|contact|privacy|terms|faq|help|search|login|register)/)"
    r"|(?:/(blog|news|press|careers|jobs|advertise)/)"
    r"|(?:/(sitemap|robots|feed|rss|atom)($|/|\.|\.xml))"
    r"|(?:\.(xml|json|txt|css|js|png|jpg|gif|ico|svg)$)"
    r"|(?:^/$)"
    r"|(?:^/[a-z]{2}/?$)"
)
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[-_\s]+', '-', 'g'),
  '[^a-z0-9-]', '', 'g'), '^-+|-+$', '', 'g'), '-+', '-', 'g')"""
ENTITIES = rf"""
parts AS (SELECT url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS raw FROM urls),
paths AS (SELECT url, host, CASE WHEN regexp_matches(raw, '[^!-~]') THEN
    array_to_string(list_transform(regexp_extract_all(raw, '.'),
      lambda c: CASE WHEN regexp_matches(c, '[^!-~]') THEN url_encode(c) ELSE c END), '') ELSE raw END AS path FROM parts),
named AS (SELECT url, CASE
  WHEN contains(host, 'poki.com') THEN regexp_extract(path, '/g/([^/]+)$', 1)
  WHEN contains(host, 'coolmathgames.com') THEN regexp_extract(path, '/[0-9]+-([^/]+)$', 1)
  WHEN contains(host, 'itch.io') THEN CASE WHEN host <> 'itch.io'
      AND regexp_extract(path, '^/([^/]+)$', 1) NOT IN ('jam', 'jams', 'games', 'tools', 'assets')
    THEN regexp_extract(path, '^/([^/]+)$', 1) END
  WHEN contains(host, 'kongregate.com') THEN regexp_extract(path, '/games/[^/]+/([^/]+)$', 1)
  WHEN contains(host, 'armorgames.com') THEN regexp_extract(path, '/(?:game|play)/([^/]+)$', 1)
  WHEN contains(host, 'newgrounds.com') THEN CASE WHEN regexp_matches(path, '/portal/view/[0-9]+$')
    THEN 'newgrounds-' || regexp_extract(path, '/portal/view/([0-9]+)$', 1) END
  WHEN contains(host, 'miniclip.com') THEN CASE WHEN regexp_extract(path, '/games/([^/]+)$', 1) <> 'genre'
    THEN regexp_extract(path, '/games/([^/]+)$', 1) END
  WHEN contains(host, 'y8.com') THEN regexp_extract(path, '/games/([^/]+)$', 1)
  WHEN contains(host, 'friv.com') THEN regexp_extract(path, '/(?:game|play)/([^/]+)$', 1)
  WHEN regexp_matches(path, '(?i)/(games?|play|g)/[^/]+$')
    THEN regexp_replace(regexp_extract(path, '(?i)/(?:games?|play|g)/([^/]+)$', 1), '\.html?$', '')
  WHEN regexp_matches(path, '(?i)/[^/]+-game$') THEN regexp_extract(path, '(?i)/([^/]+)-game$', 1)
  WHEN regexp_matches(path, '(?i)/[^/]+\.html?$') THEN regexp_extract(path, '(?i)/([^/]+)\.html?$', 1)
  ELSE regexp_extract(path, '^/([^/]+)$', 1) END AS name
  FROM paths WHERE NOT regexp_matches(path, '{_EXCLUDED}')),
kept AS (SELECT url, name, {_CLEAN} AS clean_name FROM named
  WHERE length(name) BETWEEN 2 AND 100 AND lower(name) NOT IN ({_WORDS})
    AND (NOT regexp_matches(lower(name), '-games?$')
      OR regexp_matches(lower(name), '(hunger|squid|mario|pokemon|sonic)-games?$'))),
entities AS (SELECT url, name, clean_name FROM kept WHERE length(clean_name) >= 2)
"""


@query(
    "entity_extraction",
    with_ctes("site_urls", "page_urls").rstrip()
    + ", urls AS (SELECT url FROM site_urls UNION ALL SELECT url FROM page_urls),"
    + ENTITIES
    + "SELECT * FROM entities",
)
def entity_extraction(spark, d):
    urls = fx.site_urls(spark, d).select("url").unionByName(_page_urls(spark, d).select("url"))
    return extract.extract_entities(urls)


@query(
    "clean_names",
    with_ctes("site_urls")
    + "SELECT name, "
    + _CLEAN
    + r""" AS clean_name FROM (SELECT upper(regexp_extract(url, '([^/]*)/?$', 1)) || ' _ ' || l_partkey || '!' AS name FROM site_urls)""",
)
def clean_names(spark, d):
    name = F.concat(
        F.upper(F.regexp_extract("url", "([^/]*)/?$", 1)), F.lit(" _ "), F.col("l_partkey").cast("string"), F.lit("!")
    )
    return fx.site_urls(spark, d).select(name.alias("name")).select(
        "name", slugs.normalize_name(F.col("name")).alias("clean_name")
    )


_SEGMENTS = "SELECT *, string_split(path, '/') AS segs FROM page_paths"
_KEYWORDS = rf"""
tokens AS (SELECT feed_ord, pos, CAST(i - 1 AS INTEGER) AS seg, words[i] AS keyword FROM (
  SELECT *, unnest(range(1, len(words) + 1)) AS i FROM (
    SELECT *, list_filter(list_transform(list_filter(segs, lambda s: length(s) > 2 AND NOT regexp_matches(s, '^[0-9]+$')
        AND NOT contains(s, '.') AND NOT regexp_matches(s, '(?i)^(index|page|post|article|news|blog)$')),
      lambda s: lower(replace(s, '-', ''))), lambda w: length(w) > 2) AS words FROM ({_SEGMENTS}))))
"""


@query(
    "keyword_tokens",
    with_ctes("page_paths").rstrip() + "," + _KEYWORDS + "SELECT feed_ord, pos, seg, keyword FROM tokens",
)
def keyword_tokens(spark, d):
    return reports.keyword_tokens(_page_urls(spark, d)).select("feed_ord", "pos", "seg", "keyword")


_SIMPLE = rf"""
tokens AS (SELECT feed_ord, pos, CAST(i - 1 AS INTEGER) AS seg, words[i] AS keyword FROM (
  SELECT *, unnest(range(1, len(words) + 1)) AS i FROM (
    SELECT *, list_filter(segs, lambda s: length(s) > 3 AND NOT contains(s, '-')) AS words FROM ({_SEGMENTS}))))
"""


@query(
    "simple_tokens",
    with_ctes("page_paths").rstrip() + "," + _SIMPLE + "SELECT feed_ord, pos, seg, keyword FROM tokens",
)
def simple_tokens(spark, d):
    return reports.simple_tokens(_page_urls(spark, d)).select("feed_ord", "pos", "seg", "keyword")


_TOP = "SELECT keyword, count(*) AS count FROM tokens GROUP BY keyword ORDER BY count(*) DESC, min((feed_ord, pos, seg)) LIMIT 10"


@query("keyword_top10", with_ctes("page_paths").rstrip() + "," + _KEYWORDS + _TOP)
def keyword_top10(spark, d):
    return reports.top_keywords(_page_urls(spark, d))


@query("keyword_top10_names", with_ctes("page_paths").rstrip() + "," + _KEYWORDS + f"SELECT keyword FROM ({_TOP})")
def keyword_top10_names(spark, d):
    return reports.top_keywords(_page_urls(spark, d), with_count=False)


@query(
    "keyword_distinct10",
    with_ctes("page_paths").rstrip()
    + ","
    + _SIMPLE
    + "SELECT keyword FROM tokens GROUP BY keyword ORDER BY min((feed_ord, pos, seg)) LIMIT 10",
)
def keyword_distinct10(spark, d):
    return reports.distinct_keywords(_page_urls(spark, d)).select("keyword")


@query(
    "keyword_digest",
    with_ctes("page_paths").rstrip()
    + ","
    + _SIMPLE.rstrip()
    + """, found AS (SELECT keyword, min((feed_ord, pos, seg)) AS first FROM tokens GROUP BY keyword ORDER BY first LIMIT 10)
SELECT count(*) AS feeds, count(*) FILTER (status = 200) AS success, count(*) FILTER (status <> 200) AS errors,
  count(*) FILTER (status <> 200 AND feed_ord % 3 = 0) AS timeouts, CAST(round(100.0 * count(*) FILTER (feed_ord % 7 <> 0) / count(*)) AS INTEGER) AS progress,
  (SELECT count(*) FROM page_urls) AS new_urls, (SELECT string_agg(keyword, ', ' ORDER BY first) FROM found) AS keywords FROM page_docs""",
)
def keyword_digest(spark, d):
    """The digest of all page URLs; failed pages of every third feed timed out, every seventh feed was not reached."""
    failed = F.col("status") != 200
    checks = fx.page_docs(spark, d).select(
        (~failed).alias("success"), (failed & (F.col("feed_ord") % 3 == 0)).alias("timeout"), (F.col("feed_ord") % 7 == 0).alias("threw")
    )
    return reports.keyword_digest(checks, _page_urls(spark, d))


@query(
    "host_distribution",
    with_ctes("page_urls")
    + """SELECT domain, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min((feed_ord, pos))) AS place
         FROM page_urls GROUP BY domain""",
)
def host_distribution(spark, d):
    return placed(reports.host_distribution(_page_urls(spark, d)))


@query(
    "feed_list_from_json",
    """SELECT s_suppkey, i AS feed_ord, url FROM (SELECT s_suppkey, unnest([0::BIGINT, 1::BIGINT]) AS i,
         unnest(['https://s' || s_suppkey || '.example.com/sitemap.xml', 'https://n' || s_nationkey || '.example.com/sitemap.xml']) AS url
       FROM supplier WHERE s_acctbal >= 0)""",
)
def feed_list_from_json(spark, d):
    """One stored list per supplier; suppliers in debt have a broken one."""
    lists = fx.table(spark, d, "supplier").selectExpr(
        "s_suppkey",
        """CASE WHEN s_acctbal >= 0 THEN to_json(array('https://s' || s_suppkey || '.example.com/sitemap.xml',
             'https://n' || s_nationkey || '.example.com/sitemap.xml')) ELSE '["https://s' END AS value""",
    )
    return decode_feed_list(lists)


@query(
    "inparams_rows",
    """
SELECT event_id, ip, time FROM (
  SELECT event_id, '10.0.0.' || user_id AS ip, event_type AS time FROM events WHERE event_type <> 'error'
  UNION ALL SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR), '' FROM events
    WHERE event_type NOT IN ('error', 'view'))""",
)
def inparams_rows(spark, d):
    """A request log per event: errors have no object as payload, views hold an item that is none."""
    payload = F.expr(
        """CASE event_type WHEN 'error' THEN '[1]'
             ELSE '{"data":{"inParams":[{"ip":"10.0.0.' || user_id || '","time":"' || event_type || '"},' ||
               CASE event_type WHEN 'view' THEN '7' ELSE '{"ip":' || get_json_object(props, '$.k') || '}' END || ']}}' END"""
    )
    logs = fx.table(spark, d, "events").select("event_id", payload.alias("value"))
    return request_rows(logs)
