"""Snapshot checks and snapshot tables.

Documents have the columns `feed_ord, feed_url, domain, status, error, content`;
`feed_ord` is the position of the feed in the run and is unique.  Feeds of one
domain share a snapshot, so inside a run each is compared with the last accepted
one before it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, timestamp
from ..session import cut_lineage
from .extract import url_array
from .guards import MIN_FIRST, SHRINK, accepted_baseline, fold_accepted, is_success, status_error
from .ranking import spread_join

# Reference numbers of the stored documents; those of the run use their feed_ord.
CURRENT, LATEST = -1, -2


class CheckResult(NamedTuple):
    checks: DataFrame
    diff: DataFrame
    snapshots: DataFrame
    snapshot_urls: DataFrame
    advanced_urls: DataFrame
    advanced: DataFrame


class DailyResult(NamedTuple):
    checks: DataFrame
    diff: DataFrame
    state: DataFrame
    dated: DataFrame


def fetched(docs: DataFrame) -> Column:
    """Whether the document was delivered: a 2xx status and no fetch error."""
    return F.coalesce(docs["status"].between(200, 299), F.lit(False)) & docs["content"].isNotNull()


def fetch_error(status: Column, error: Column) -> Column:
    return F.coalesce(blank_to_null(error), F.concat(F.lit("HTTP "), status.cast("string")), F.lit("no document"))


def listed_rows(documents: DataFrame, mode: str) -> DataFrame:
    """The URLs of all `documents(domain, ref, content)` as written rows `(domain, ref, pos, url)`.

    Bodies are read and parsed here only, once per run; a document without URLs has one row without a URL.
    """
    urls = F.posexplode_outer(url_array(F.col("content"), mode)).alias("pos", "url")
    rows = documents.select("domain", "ref", urls)
    return cut_lineage(rows.withColumn("pos", F.col("pos").cast("bigint")))


def pair_diff(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """For every `pairs(feed_ord, domain, left_ref, right_ref)` the URLs of the left
    document that the right one lacks, as `(feed_ord, domain, pos, url)`.

    `listed(domain, ref, pos, url)` holds the URLs of all documents; pairs are narrow,
    one per feed.
    """
    listed = listed.filter("url is not null")
    wanted = pairs.select("domain", F.col("left_ref").alias("ref"), "feed_ord", "right_ref")
    left = listed.join(wanted, ["domain", "ref"]).select("feed_ord", "domain", "right_ref", "pos", "url")
    held = pairs.select("domain", F.col("right_ref").alias("ref")).distinct()
    right = listed.join(held, ["domain", "ref"], "left_semi").select("domain", F.col("ref").alias("right_ref"), "url")
    return left.join(right.distinct(), ["domain", "right_ref", "url"], "left_anti").select(
        "feed_ord", "domain", "pos", "url"
    )


def snapshot_check(
    docs: DataFrame,
    snapshots: DataFrame,
    snapshot_urls: DataFrame,
    as_of,
    gen: int = 0,
    mode: str = "strict",
    min_first: int = MIN_FIRST,
    shrink: float = SHRINK,
) -> CheckResult:
    """Check every document against the last accepted snapshot of its domain.

    The bodies are parsed once; every output reads the written URL rows.  These are
    compared with the stored snapshot first, and only the few that are left are
    matched with their check, so URL lists are never shuffled just to be filtered.
    The narrow fold result (one row per feed) is checkpointed, because five outputs
    read it.
    """
    listed = listed_rows(docs.filter(fetched(docs)).select("domain", F.col("feed_ord").alias("ref"), "content"), mode)
    counts = listed.groupBy("domain", F.col("ref").alias("run")).agg(F.count("url").alias("url_count"))
    folded = cut_lineage(accepted_baseline(counts, snapshots, min_first, shrink))

    meta = docs.select("feed_ord", "feed_url", "domain", fetch_error(docs["status"], docs["error"]).alias("_failed"))
    state = folded.select(
        F.col("run").alias("feed_ord"),
        "domain",
        F.col("url_count").alias("total_urls"),
        "baseline",
        F.col("status").alias("check_status"),
    )
    status = F.coalesce("check_status", F.lit("fetch_error"))
    error = F.when(F.col("check_status").isNull(), F.col("_failed")).otherwise(
        status_error(F.col("check_status"), F.col("total_urls"), F.col("baseline"))
    )
    checks = meta.join(state, ["feed_ord", "domain"], "left").select(
        "feed_ord",
        "feed_url",
        "domain",
        status.alias("check_status"),
        is_success(status).alias("success"),
        error.alias("error"),
        "baseline",
        F.coalesce("total_urls", F.lit(0)).alias("total_urls"),
    )

    compared = folded.filter("status = 'ok'").select(
        F.col("run").alias("feed_ord"), "domain", F.col("run").alias("left_ref"), F.col("baseline_run").alias("right_ref")
    )
    rows = listed.filter("url is not null").select(F.col("ref").alias("feed_ord"), "domain", "pos", "url")
    unseen = rows.join(snapshot_urls.select("domain", "url").distinct(), ["domain", "url"], "left_anti")
    stored = compared.filter(F.col("right_ref") == CURRENT).select("feed_ord", "domain")
    from_stored = unseen.join(stored, ["feed_ord", "domain"], "left_semi").select("feed_ord", "domain", "pos", "url")
    diff = from_stored.unionByName(pair_diff(compared.filter(F.col("right_ref") != CURRENT), listed))

    last = folded.filter("accepted").groupBy("domain").agg(F.max_by(F.struct("run", "url_count"), "run").alias("w"))
    winners = last.select("domain", "w.run", "w.url_count")
    headers = winners.select(
        "domain",
        F.lit(gen).cast("bigint").alias("gen"),
        F.col("url_count").cast("bigint").alias("url_count"),
        timestamp(as_of).alias("updated_at"),
    )
    passed_over = folded.join(winners, ["domain", "run"], "left_anti").select(F.col("run").alias("feed_ord"))
    advanced = rows.join(passed_over, "feed_ord", "left_anti").select("domain", "pos", "url")
    return CheckResult(
        checks,
        diff,
        upsert_snapshots(snapshots, headers),
        replace_urls(snapshot_urls, advanced, winners.select("domain")),
        advanced,
        headers,
    )


def replace_urls(old: DataFrame, new: DataFrame, domains: DataFrame) -> DataFrame:
    """Snapshot URLs with those of `domains` replaced; the URLs of a domain are spread over several tasks."""
    kept = spread_join(old, domains, ["domain"], "left_anti", ["url"])
    return kept.select("domain", "pos", "url").unionByName(new)


def with_new_counts(checks: DataFrame, diff: DataFrame) -> DataFrame:
    """Adds `new_urls` per feed."""
    counts = diff.groupBy("feed_ord").agg(F.count("*").alias("new_urls"))
    return checks.join(counts, "feed_ord", "left").withColumn("new_urls", F.coalesce("new_urls", F.lit(0)))


# --- snapshot tables -------------------------------------------------------


def lookup_snapshot(domains: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Content per domain; an empty document counts as absent."""
    found = snapshots.select("domain", blank_to_null(F.col("content")).alias("content"))
    return domains.join(found, "domain", "left")


def lookup_by_kind(snapshots: DataFrame, kind: str = "current", date: str | None = None, as_of=None) -> DataFrame:
    """Documents of one kind; `dated` takes a yyyyMMdd day, by default that of `as_of`.

    An unknown kind finds nothing.  Both columns are partition columns.
    """
    if kind not in ("current", "latest", "dated"):
        return snapshots.filter(F.lit(False))
    rows = snapshots.filter(F.col("kind") == kind)
    if kind == "dated":
        day = F.lit(date) if date else F.date_format(timestamp(as_of), "yyyyMMdd")
        rows = rows.filter(F.col("date") == day)
    return rows


def upsert_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """`new` replaces the rows of its domains; it holds one row per domain."""
    kept = old.join(new.select("domain"), "domain", "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def rotate_snapshots(old: DataFrame, new: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """`old(domain, current, latest, last_update)` and `new(domain, content)` to the next
    state and the dated copies.  `latest` moves only where a current document exists."""
    day = F.date_format(timestamp(as_of), "yyyyMMdd")
    arrived = new.select("domain", F.col("content").alias("_new"), F.lit(True).alias("_arrived"))
    both = old.join(arrived, "domain", "full_outer")
    moved = F.coalesce("_arrived", F.lit(False))
    state = both.select(
        "domain",
        F.when(moved, F.col("_new")).otherwise(F.col("current")).alias("current"),
        F.when(moved, F.coalesce(blank_to_null(F.col("current")), F.col("latest")))
        .otherwise(F.col("latest"))
        .alias("latest"),
        F.when(moved, day).otherwise(F.col("last_update")).alias("last_update"),
    )
    return state, new.select("domain", day.alias("date"), "content")


# --- daily rule ------------------------------------------------------------


def daily_check(docs: DataFrame, state: DataFrame, as_of, force: bool = False) -> DailyResult:
    """The unguarded check with the same-day rule.

    `state(domain, current, latest, last_update)` holds documents.  A domain that
    was updated today is not fetched again: its current document is compared with
    the latest one, so the same news are reported again.  The first feed of a domain
    fetched in this run makes its later feeds same-day feeds.  `force` fetches all.

    Outcome per feed: fetched, same_day_news, same_day or fetch_error.
    """
    today = F.date_format(timestamp(as_of), "yyyyMMdd")
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    known = state.select(
        "domain",
        has(F.col("current")).alias("has_current"),
        has(F.col("latest")).alias("has_latest"),
        F.coalesce(F.col("last_update") == today, F.lit(False)).alias("done_today"),
    )
    feeds = docs.select(
        "feed_ord",
        "feed_url",
        "domain",
        fetched(docs).alias("ok"),
        has(F.col("content")).alias("has_content"),
        fetch_error(docs["status"], docs["error"]).alias("failed"),
    ).join(known, "domain", "left")
    feeds = feeds.fillna(False, ["has_current", "has_latest", "done_today"])

    if force:
        runs = feeds.filter("ok").select("domain", F.col("feed_ord").alias("run"), F.lit(1).alias("url_count"))
        previous = fold_accepted(runs, guarded=False).select(
            "domain", F.col("run").alias("feed_ord"), F.col("baseline_run").alias("previous")
        )
        content = feeds.select(F.col("feed_ord").alias("previous"), F.col("has_content").alias("has_previous"))
        seen = feeds.join(previous, ["domain", "feed_ord"], "left").join(content, "previous", "left")
        right = F.when(F.col("previous").isNotNull(), F.when(F.col("has_previous"), F.col("previous"))).when(
            F.col("has_current"), F.lit(CURRENT)
        )
        refs = seen.select(
            *feeds.columns,
            F.when(F.col("ok"), F.col("feed_ord")).alias("left_ref"),
            F.when(F.col("ok"), right).cast("bigint").alias("right_ref"),
            F.when(F.col("ok"), "fetched").otherwise("fetch_error").alias("outcome"),
        )
    else:
        firsts = (
            feeds.filter("ok and not done_today")
            .groupBy("domain")
            .agg(F.min_by(F.struct("feed_ord", "has_content"), "feed_ord").alias("f"))
            .select("domain", F.col("f.feed_ord").alias("first_ok"), F.col("f.has_content").alias("first_has"))
        )
        seen = feeds.join(firsts, "domain", "left")
        is_first = F.col("feed_ord") == F.col("first_ok")
        later = F.col("feed_ord") > F.col("first_ok")
        kept = F.when(F.col("has_current"), F.lit(CURRENT)).when(F.col("has_latest"), F.lit(LATEST))
        left = (
            F.when(F.col("done_today"), F.when(F.col("has_current"), F.lit(CURRENT)))
            .when(is_first, F.col("feed_ord"))
            .when(later & F.col("first_has"), F.col("first_ok"))
        )
        right = (
            F.when(F.col("done_today"), F.when(F.col("has_latest"), F.lit(LATEST)))
            .when(is_first, F.when(F.col("has_current"), F.lit(CURRENT)))
            .when(later, kept)
        )
        both = left.isNotNull() & right.isNotNull()
        outcome = (
            F.when(is_first, "fetched")
            .when(F.col("done_today") | later, F.when(both, "same_day_news").otherwise("same_day"))
            .otherwise("fetch_error")
        )
        refs = seen.select(
            *feeds.columns,
            left.cast("bigint").alias("left_ref"),
            right.cast("bigint").alias("right_ref"),
            outcome.alias("outcome"),
        )

    refs = cut_lineage(refs)
    documents = (
        docs.filter(fetched(docs))
        .select("domain", F.col("feed_ord").cast("bigint").alias("ref"), "content")
        .unionByName(state.select("domain", F.lit(CURRENT).cast("bigint").alias("ref"), F.col("current").alias("content")))
        .unionByName(state.select("domain", F.lit(LATEST).cast("bigint").alias("ref"), F.col("latest").alias("content")))
        .filter("content is not null")
    )
    listed = listed_rows(documents, "lenient")
    pairs = refs.filter("left_ref is not null and right_ref is not null")
    diff = pair_diff(pairs.select("feed_ord", "domain", "left_ref", "right_ref"), listed)
    checks = refs.select(
        "feed_ord",
        "feed_url",
        "domain",
        "outcome",
        (F.col("outcome") != "fetch_error").alias("success"),
        F.when(F.col("outcome") == "fetch_error", F.col("failed")).otherwise("").alias("error"),
    )

    # Next state: the last fetched document is current, the last non-empty one before it is latest.
    took = refs.filter("outcome = 'fetched'").select("domain", F.col("feed_ord").alias("ref"), "has_content")
    moved = took.groupBy("domain").agg(F.max("ref").alias("cur_ref"))
    older = (
        took.filter("has_content")
        .select("domain", "ref")
        .unionByName(known.filter("has_current").select("domain", F.lit(CURRENT).cast("bigint").alias("ref")))
        .unionByName(known.filter("has_latest").select("domain", F.lit(LATEST).cast("bigint").alias("ref")))
    )
    latest = (
        older.join(moved, "domain")
        .filter("ref < cur_ref")
        .groupBy("domain")
        .agg(F.max("ref").alias("lat_ref"))
    )
    content = documents.select("domain", F.col("ref").alias("_r"), F.col("content").alias("_c"))
    slots = moved.join(latest, "domain", "left")
    for slot, name in (("cur_ref", "current"), ("lat_ref", "latest")):
        slots = (
            slots.join(content.withColumnRenamed("_r", slot), ["domain", slot], "left")
            .withColumnRenamed("_c", name)
        )
    fresh = slots.select("domain", "current", "latest", today.alias("last_update"))
    untouched = state.join(moved.select("domain"), "domain", "left_anti")
    next_state = untouched.select("domain", "current", "latest", "last_update").unionByName(fresh)
    return DailyResult(checks, diff, next_state, fresh.select("domain", today.alias("date"), F.col("current").alias("content")))
