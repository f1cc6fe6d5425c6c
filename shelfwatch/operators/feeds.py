"""The feed list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_id, timestamp, trim_spaces
from ..functions.urls import url_host
from .ranking import number_rows


def list_feeds(feeds: DataFrame, newest_first: bool = False) -> DataFrame:
    """Oldest first with NULL times last, or newest first with NULL times first; ties by url."""
    at = F.col("created_at")
    return feeds.orderBy(at.desc_nulls_first() if newest_first else at.asc_nulls_last(), "url")


def feed_order(feeds: DataFrame) -> DataFrame:
    """Adds `feed_ord`, the position in the oldest-first list."""
    return number_rows(feeds, [F.col("created_at").asc_nulls_last(), F.col("url")], "feed_ord")


def new_feed_rows(adds: DataFrame, as_of) -> DataFrame:
    url, now = F.col("url"), timestamp(as_of)
    return adds.select(
        entity_id(url).alias("id"), "url", url_host(url).alias("domain"), now.alias("created_at"), now.alias("updated_at")
    )


def upsert_feeds(feeds: DataFrame, adds: DataFrame, as_of) -> DataFrame:
    """Insert or update by url: a known feed keeps id and created_at."""
    fresh = new_feed_rows(adds.select("url").distinct(), as_of)
    both = feeds.select(*[F.col(c).alias(f"_old_{c}") if c != "url" else F.col(c) for c in feeds.columns]).join(
        fresh, "url", "full_outer"
    )
    return both.select(
        F.coalesce("_old_id", "id").alias("id"),
        "url",
        F.coalesce("domain", "_old_domain").alias("domain"),
        F.when(F.col("_old_id").isNotNull(), F.col("_old_created_at")).otherwise(F.col("created_at")).alias("created_at"),
        F.coalesce("updated_at", "_old_updated_at").alias("updated_at"),
    ).select(*feeds.columns)


def insert_feeds(feeds: DataFrame, adds: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Strict insert: `(feeds, rejects)`; a url already listed is rejected, as is its second mention."""
    mentions = adds.groupBy("url").agg(F.count("*").alias("mentions"))
    fresh = mentions.join(feeds.select("url"), "url", "left_anti")
    known = mentions.join(feeds.select("url"), "url", "left_semi").select("url", F.col("mentions").alias("rejected"))
    again = fresh.filter("mentions > 1").select("url", (F.col("mentions") - 1).alias("rejected"))
    rejects = known.unionByName(again).withColumn("error", F.lit("duplicate url"))
    return feeds.unionByName(new_feed_rows(fresh, as_of).select(*feeds.columns)), rejects


def append_feeds(feeds: DataFrame, adds: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordered list append: `feeds(feed_ord, url)`, `adds(add_ord, url)` and the outcome of
    their checks, `checks(url, success, error)`.  A failed check adds nothing."""
    known = feeds.select("url", F.lit(True).alias("_known"))
    tried = adds.join(known, "url", "left").join(checks.select("url", "success", "error"), "url", "left")
    firsts = adds.groupBy("url").agg(F.min("add_ord").alias("_first"))
    tried = tried.join(firsts, "url")
    listed = F.col("_known").isNotNull() | (F.col("add_ord") > F.col("_first"))
    ok = F.coalesce("success", F.lit(False))
    outcome = tried.select(
        "add_ord",
        "url",
        F.when(~ok, "failed").when(listed, "updated").otherwise("added").alias("outcome"),
        F.when(~ok, F.col("error")).when(listed, F.lit("known feed updated")).otherwise(
            F.when(F.col("error") != "", F.col("error")).otherwise(F.lit("added"))
        ).alias("message"),
    )
    last = feeds.agg(F.coalesce(F.max("feed_ord"), F.lit(-1)).alias("_last"))
    added = outcome.filter("outcome = 'added'").crossJoin(F.broadcast(last))
    grown = added.select((F.col("_last") + 1 + F.col("add_ord")).alias("feed_ord"), "url")
    return feeds.select("feed_ord", "url").unionByName(grown), outcome


def add_checked(
    feeds: DataFrame, adds: DataFrame, checks: DataFrame, changes: DataFrame, as_of
) -> tuple[DataFrame, DataFrame]:
    """Add the feeds whose check succeeded: `(feeds, new_urls)`.  Only URLs of new entities are
    returned, those of cross-platform ones are left out."""
    good = checks.filter("success").select("feed_ord", F.col("feed_url").alias("url"))
    good = good.join(adds.select("url").distinct(), "url", "left_semi")
    urls = changes.filter("is_new").join(good.select("feed_ord"), "feed_ord", "left_semi")
    return upsert_feeds(feeds, good, as_of), urls.select("feed_ord", "domain", "pos", "url")


def remove_feeds(feeds: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(feeds, missing)`: requests for a url that is not listed are returned."""
    wanted = urls.select("url").distinct()
    return feeds.join(wanted, "url", "left_anti").select(*feeds.columns), wanted.join(
        feeds.select("url"), "url", "left_anti"
    )


def remove_feeds_by_id(feeds: DataFrame, ids: DataFrame) -> DataFrame:
    return feeds.join(ids.select("id").distinct(), "id", "left_anti").select(*feeds.columns)


def reject_reason(url: Column) -> Column:
    """NULL for an acceptable feed url."""
    return (
        F.when(url.isNull() | (trim_spaces(url) == ""), "blank")
        .when(url_host(url).isNull(), "invalid url")
        .when(~F.lower(url).contains("sitemap"), "not a sitemap")
    )


def validate_feeds(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("reject_reason", reject_reason(F.col("url")))
    return (
        checked.filter("reject_reason is null").drop("reject_reason"),
        checked.filter("reject_reason is not null"),
    )


def cap_feeds(feeds: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first `n` feeds of the run (all without `n`) and how many are left for later."""
    total = feeds.agg(F.count("*").alias("total"))
    skipped = F.greatest(F.col("total") - F.lit(n), F.lit(0)) if n is not None else F.lit(0)
    taken = list_feeds(feeds)
    return (taken if n is None else taken.limit(n)), total.select("total", skipped.cast("bigint").alias("skipped"))


def distinct_domains(feeds: DataFrame) -> DataFrame:
    """Domains in order of their newest feed; a feed without time counts as newest."""
    first = F.max(F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp"))).alias("newest")
    return feeds.groupBy("domain").agg(first).orderBy(F.col("newest").desc(), "domain")


def feed_count(feeds: DataFrame) -> DataFrame:
    return feeds.agg(F.count("*").alias("feeds"))


def feed_card(feeds: DataFrame) -> DataFrame:
    """Newest first, with the days of adding and of the last update."""
    return list_feeds(feeds, newest_first=True).select(
        "url", "domain", F.to_date("created_at").alias("added_on"), F.to_date("updated_at").alias("updated_on")
    )
