"""Whole jobs: files in and out, table versions, full runs and streams."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import extract_entities
from ..plans.full_run import commit_run, full_run, load_state
from ..session import shared_path
from ..sources import tables
from ..sources.documents import land_documents, read_urls
from ..sources.members import Members
from ..sources.request_logs import request_rows, write_request_csv
from ..sources.url_store import append_urls, diff_stored, url_store
from ..streaming import streams
from . import fixtures as fx
from .changes import CHECK, CHECK_DIFF, show_baseline, stored_snapshot, walk
from .extraction import ENTITIES
from .fixtures import with_ctes
from .registry import query

@query(
    "landed_documents",
    with_ctes("page_urls") + "SELECT feed_ord, domain, status, pos, url FROM page_urls",
)
def landed_documents(spark, d):
    """Documents landed as one file each, every other one with gzip, read back in records with their fetch records."""
    docs, rows = fx.page_docs(spark, d), []
    odd = F.coalesce(F.col("feed_ord") % 2 != 0, F.lit(False))
    for some, kind in ((docs.filter(~odd), "gzip"), (docs.filter(odd), "none")):
        path = shared_path(spark, f"landing-{kind}")
        rows.append(read_urls(spark, path, land_documents(some, path, kind == "gzip")))
    return rows[0].unionByName(rows[1]).select("feed_ord", "domain", "status", "pos", "url")


@query(
    "inparams_csv",
    "SELECT '10.0.0.' || user_id AS ip, event_type AS time FROM events",
)
def inparams_csv(spark, d):
    payload = F.expr(
        """'{"data":{"inParams":[{"ip":"10.0.0.' || user_id || '","time":"' || event_type || '"},[]]}}' AS value"""
    )
    path = shared_path(spark, "request-csv")
    write_request_csv(request_rows(fx.table(spark, d, "events").select(payload)), path)
    return spark.read.csv(path, header=True, schema="ip string, time string").fillna("")


@query(
    "tables_reset",
    with_ctes("feeds")
    + """SELECT 'feeds' AS name, count(*) AS rows FROM feeds UNION ALL
         SELECT t, 0::BIGINT FROM (VALUES ('games'), ('game_sources')) v(t)""",
)
def tables_reset(spark, d):
    root = shared_path(spark, "tables")
    frames = {"feeds": fx.feeds(spark, d), "games": fx.games(spark, d), "game_sources": fx.sources(spark, d)}
    tables.create_tables(spark, root)
    tables.commit(spark, root, tables.next_gen(spark, root), frames)
    tables.reset_tables(spark, root)
    counts = [
        tables.read_table(spark, root, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        for n in frames
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def known_games(known):
    """One game per clean name, however many spellings its sites have: the smallest name, the count of all its sites."""
    names = known.groupBy("clean_name").agg(F.min("name").alias("name"))
    return fx.games_of(known.select("clean_name", "domain", "listed_at").distinct().join(names, "clean_name"))


_RUN_AT = "2024-02-20 08:00:00"
_BLANK = "'' AS url, '' AS name, '' AS clean_name, false AS is_new, false AS is_cross"


@query(
    "full_run",
    CHECK.rstrip()
    + ","
    + CHECK_DIFF.rstrip()
    + ", urls AS (SELECT DISTINCT url FROM diff UNION SELECT url FROM stored),"
    + ENTITIES.rstrip()
    + f""", held AS (SELECT DISTINCT e.name, e.clean_name, s.domain, s.url FROM stored s JOIN entities e ON e.url = s.url),
sources AS (SELECT clean_name, domain, min(url) AS url FROM held GROUP BY clean_name, domain),
games AS (SELECT clean_name, min(name) AS name, count(DISTINCT domain) AS n FROM held GROUP BY clean_name),
candidates AS (SELECT d.*, e.name, e.clean_name FROM diff d JOIN entities e ON e.url = d.url),
firsts AS (SELECT *, row_number() OVER (PARTITION BY clean_name ORDER BY feed_ord, pos, url) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY clean_name, domain ORDER BY feed_ord, pos, url) AS k FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.clean_name = c.clean_name AND s.domain = c.domain)) WHERE k = 1),
changes AS (SELECT f.*, g.n IS NULL AND r = 1 AS is_new, coalesce(g.n, 0) + r - 1 AS before FROM firsts f LEFT JOIN games g ON g.clean_name = f.clean_name),
log AS (SELECT *, checked_at < TIMESTAMP '{_RUN_AT}' - INTERVAL 30 DAY AS old FROM (
  SELECT 'u' || user_id || '.example.com' AS domain, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, ts AS checked_at FROM events))
SELECT 'change' AS part, feed_ord, pos, domain, url, name, clean_name, is_new, NOT is_new AS is_cross,
  CASE WHEN is_new THEN -1 ELSE before END AS n FROM changes
UNION ALL SELECT 'cleaned', 0, 0, '', {_BLANK}, count(*) FROM log WHERE old
UNION ALL SELECT 'log', 0, 0, domain, {_BLANK}, n FROM log WHERE NOT old
UNION ALL SELECT 'log', feed_ord, 0, domain, {_BLANK}, count(*) FROM changes GROUP BY feed_ord, domain
UNION ALL SELECT 'item', feed_ord, pos, '', url, name, '', false, NOT is_new, CASE WHEN is_new THEN -1 ELSE before END FROM changes
UNION ALL SELECT 'game', 0, 0, '', '', coalesce(any_value(g.name), min(f.name) FILTER (f.r = 1)), clean_name, false, false,
  coalesce(any_value(g.n), 0) + count(f.r) FROM games g FULL JOIN firsts f USING (clean_name) GROUP BY clean_name
UNION ALL SELECT 'source', 0, 0, domain, url, '', '', false, false, 0 FROM (
  SELECT domain, url FROM sources UNION ALL SELECT domain, url FROM firsts)""",
)
def full_run_tables(spark, d):
    """A run over the stored catalogs, the entities behind them and the events as logs; its changes and the tables it leaves."""
    headers, urls = stored_snapshot(spark, d)
    known = extract_entities(urls.withColumn("feed_ord", F.lit(0).cast("bigint"))).withColumn("listed_at", fx.at("2024-01-01"))
    games = known_games(known)
    sources = fx.sources_of(known.groupBy("clean_name", "domain", "listed_at").agg(F.min("url").alias("url")))
    logs = fx.logs(spark, d).select(
        F.col("id").cast("string").alias("id"), "domain", F.lit(0).cast("bigint").alias("feed_ord"), "new_games_count",
        F.col("checked_at").cast("timestamp").alias("checked_at"),
    )
    items = spark.createDataFrame([], tables.TABLES["update_log_items"])
    root = shared_path(spark, "tables")
    names = ("games", "game_sources", "snapshot_urls", "snapshots", "update_logs", "update_log_items")
    tables.commit(spark, root, 0, dict(zip(names, (games, sources, urls, headers, logs, items), strict=True)))
    result = full_run(fx.page_docs(spark, d), load_state(spark, root), _RUN_AT, 1)
    commit_run(spark, root, 1, result)

    read = {n: tables.read_table(spark, root, n) for n in names}
    shape = {
        "feed_ord": F.lit(0).cast("bigint"), "pos": F.lit(0).cast("bigint"), "domain": F.lit(""), "url": F.lit(""), "name": F.lit(""),
        "clean_name": F.lit(""), "is_new": F.lit(False), "is_cross": F.lit(False),
    }

    def part(name, rows, n, *shown):
        columns = [(F.col(c) if c in shown else default).alias(c) for c, default in shape.items()]
        return rows.select(F.lit(name).alias("part"), *columns, n.cast("bigint").alias("n"))

    count = F.coalesce("platform_count", F.lit(-1))
    parts = [
        part("change", result.changes, count, *shape),
        part("cleaned", result.report["cleaned"], F.col("deleted")),
        part("log", read["update_logs"], F.col("new_games_count"), "domain", "feed_ord"),
        part("item", read["update_log_items"], count, "feed_ord", "pos", "url", "name", "is_cross"),
        part("game", read["games"], F.col("platform_count"), "name", "clean_name"),
        part("source", read["game_sources"], F.lit(0), "domain", "url"),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- streams ---------------------------------------------------------------


@query(
    "stream_daily_counts",
    """WITH landed AS (SELECT ts, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS portion FROM events),
       mark AS (SELECT max(ts) - INTERVAL 1 DAY AS at FROM landed WHERE portion = 1)
       SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM landed, mark
       WHERE portion = 1 OR date_trunc('day', ts) + INTERVAL 1 DAY > mark.at GROUP BY 1""",
)
def stream_daily_counts(spark, d):
    """The events land in two portions; rows of the second for days that are closed by then are dropped."""
    landing, out, state = (shared_path(spark, n) for n in ("events", "daily", "daily-state"))
    events = fx.table(spark, d, "events").select("ts", "user_id")
    for late in (False, True):
        events.filter((F.col("user_id") % 2 != 0) == late).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(events.schema).parquet(landing)
        streams.stream_daily_counts(stream, out, state).awaitTermination()
    return streams.read_daily_counts(spark, out).select(fx.day("date").alias("date"), "n")


@query(
    "stream_first_seen",
    with_ctes("listings")
    + """SELECT clean_name, feed_ord, pos, url, domain FROM (SELECT *, row_number() OVER
           (PARTITION BY clean_name ORDER BY pos % 2, feed_ord, pos, url) AS k FROM listings) WHERE k = 1""",
)
def stream_first_seen(spark, d):
    """Even places land first; names of the second portion count only if the first lacks them."""
    landing, out, state = (shared_path(spark, n) for n in ("listed", "first-seen", "first-seen-state"))
    rows = fx.listings(spark, d).select("clean_name", "feed_ord", "pos", "url", "domain")
    for odd in (0, 1):
        rows.filter(F.col("pos") % 2 == odd).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        streams.stream_first_seen(stream, out, state).awaitTermination()
    return spark.read.parquet(out).select("clean_name", "feed_ord", "pos", "url", "domain")


@query(
    "stream_first_seen_filtered",
    with_ctes("listings")
    + """SELECT clean_name, feed_ord, pos, url, domain, pos % 3 AS batch FROM (SELECT *, row_number() OVER
           (PARTITION BY clean_name ORDER BY pos % 3, feed_ord, pos, url) AS k FROM listings) WHERE k = 1""",
)
def stream_first_seen_filtered(spark, d):
    """Three portions; stored names lie behind filters, and only partitions that may hold a name are opened."""
    landing, out, state, stored = (shared_path(spark, n) for n in ("listed", "first-seen", "first-seen-state", "members"))
    rows = fx.listings(spark, d).select("clean_name", "feed_ord", "pos", "url", "domain")
    members = Members(stored, parts=32, words=1 << 12)
    for portion in range(3):
        rows.filter(F.col("pos") % 3 == portion).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        streams.stream_first_seen(stream, out, state, members=members).awaitTermination()
    found = spark.read.parquet(out)
    return found.select("clean_name", "feed_ord", "pos", "url", "domain", F.col("batch").cast("long").alias("batch"))


_SHRUNK = "feed_ord % 3 = 0"


@query(
    "stored_url_diff",
    with_ctes("listings")
    + f"""SELECT feed_ord, domain, pos, url FROM listings n WHERE is_open AND NOT EXISTS (SELECT 1 FROM listings o
           WHERE o.domain = n.domain AND o.url = n.url
             AND o.listed_at < CASE WHEN {_SHRUNK.replace("feed_ord", "o.feed_ord")} THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '1999-01-01' END)""",
)
def stored_url_diff(spark, d):
    """Two runs are stored in buckets, the second for every third site with fewer URLs; the third is compared with them."""
    store = url_store(spark, shared_path(spark, "urls"))
    old = fx.old_listings(spark, d)
    append_urls(store, old, 0)
    append_urls(store, old.filter(_SHRUNK).filter(F.col("listed_at") < fx.at("1995-01-01")), 1)
    sites = fx.listings(spark, d).select("feed_ord", "domain").distinct()
    headers = sites.select("domain", F.expr(f"IF({_SHRUNK}, 1L, 0L)").alias("gen"))
    new = fx.new_listings(spark, d).select("feed_ord", "domain", "pos", "url")
    return diff_stored(new, headers, spark.table(store))


_LATE = "run % 7 = 3"


@query(
    "stream_last_accepted",
    with_ctes("history").rstrip()
    + ","
    + walk(
        f"""SELECT domain, run + CASE WHEN {_LATE} THEN 2000 WHEN run >= 15 THEN 1000 ELSE 0 END AS run, url_count AS c
            FROM history""",
        "SELECT NULL AS domain, CAST(NULL AS BIGINT) AS b",
    )
    + """SELECT domain, run % 1000 AS run, c AS url_count, coalesce(b, -1) AS baseline, coalesce(bf % 1000, -2) AS baseline_run,
           status, status IN ('ok', 'first_ok') AS accepted FROM folded""",
)
def stream_last_accepted(spark, d):
    """The counts land in three portions, the last one late; each start of the stream goes on from the stored states."""
    landing, out, state = (shared_path(spark, n) for n in ("counts", "accepted", "accepted-state"))
    history = fx.history(spark, d)
    in_time = history.filter(f"not ({_LATE})")
    for portion in (in_time.filter("run < 15"), in_time.filter("run >= 15"), history.filter(_LATE)):
        portion.write.mode("append").parquet(landing)
        counts = spark.readStream.schema(history.schema).parquet(landing)
        streams.stream_baseline(counts, out, state).awaitTermination()
    return show_baseline(spark.read.parquet(f"{out}/checks")).select(
        "domain", "run", "url_count", "baseline", "baseline_run", "status", "accepted"
    )


@query(
    "stream_diff",
    with_ctes("page_urls").rstrip()
    + ","
    + walk(
        """SELECT p.domain, p.feed_ord + CASE WHEN p.status = 404 THEN 0 ELSE 1000000000000 END AS run, count(u.url) AS c
           FROM page_docs p LEFT JOIN page_urls u ON u.feed_ord = p.feed_ord GROUP BY p.domain, p.feed_ord, p.status""",
        "SELECT NULL AS domain, CAST(NULL AS BIGINT) AS b",
    ).rstrip()
    + """, winners AS (SELECT domain, max(run) AS run FROM folded WHERE status IN ('ok', 'first_ok') GROUP BY domain)
SELECT f.domain, f.c AS url_count FROM folded f JOIN winners w ON w.domain = f.domain AND w.run = f.run""",
)
def stream_diff(spark, d):
    """The failed pages land first and count as fetched, the others land afterwards."""
    landing, root, state = (shared_path(spark, n) for n in ("documents", "tables", "diff-state"))
    docs = fx.page_docs(spark, d).withColumn("path", F.concat(F.lit("page-"), F.col("feed_ord").cast("string")))

    def meta(_):
        return docs.select("path", "feed_ord", "feed_url", F.lit(200).alias("status"), "error")

    for portion in (docs.filter("status = 404"), docs.filter("status = 200")):
        portion.select("path", "content").write.mode("append").parquet(landing)
        files = spark.readStream.schema("path string, content string").parquet(landing)
        query_ = streams.stream_diff(files, root, state, meta, lambda b: f"2024-01-{b + 1:02d} 08:00:00")
        query_.awaitTermination()
    return tables.read_table(spark, root, "snapshots").select("domain", "url_count")
