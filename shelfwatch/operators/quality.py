"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import timestamp

MIN_URLS = 10


def days_before(as_of, days: int) -> Column:
    return timestamp(as_of) - F.make_dt_interval(F.lit(days))


def domain_summary(sources: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct games and time range per domain, most games first; the first `n` or all."""
    rows = sources.groupBy("domain").agg(
        F.countDistinct("game_id").alias("game_count"),
        F.min("first_seen").alias("first_added"),
        F.max("first_seen").alias("last_added"),
    )
    rows = rows.orderBy(F.col("game_count").desc(), "domain")
    return rows if n is None else rows.limit(n)


def recent(df: DataFrame, as_of, days: int = 7, at: str = "first_seen") -> DataFrame:
    return df.filter(F.col(at) > days_before(as_of, days))


def new_per_day(games: DataFrame, as_of, days: int = 7, at: str = "first_seen") -> DataFrame:
    day = F.to_date(at).alias("date")
    return recent(games, as_of, days, at).groupBy(day).agg(F.count("*").alias("new_games")).orderBy(F.col("date").desc())


def on_day(df: DataFrame, as_of, at: str = "first_seen") -> DataFrame:
    return df.filter(F.to_date(at) == F.to_date(timestamp(as_of)))


def new_today(games: DataFrame, as_of) -> DataFrame:
    return on_day(games, as_of).agg(F.count("*").alias("today_new_games"))


def games_since(games: DataFrame, ts) -> DataFrame:
    rows = games.filter(F.col("first_seen") > timestamp(ts))
    return rows.select("name", "platform_count", "first_seen").orderBy(F.col("first_seen").desc_nulls_first(), "name")


def domain_sources(sources: DataFrame, domain: str) -> DataFrame:
    return sources.filter(F.col("domain") == domain)


def domain_games(games: DataFrame, sources: DataFrame, domain: str, n: int = 20) -> DataFrame:
    """The latest `n` games of a domain."""
    has_game = domain_sources(sources, domain).filter("game_id is not null")
    latest = has_game.join(games.select(F.col("id").alias("game_id"), "name", "platform_count"), "game_id")
    return (
        latest.orderBy(F.col("first_seen").desc_nulls_first(), "url")
        .limit(n)
        .select("name", "platform_count", "url", "first_seen")
    )


def implausible(snapshots: DataFrame, min_urls: int = MIN_URLS, order: str = "updated") -> DataFrame:
    rows = snapshots.filter(F.col("url_count") < min_urls).select("domain", "url_count", "updated_at")
    if order == "updated":
        return rows.orderBy(F.col("updated_at").desc_nulls_first(), "domain")
    return rows.orderBy("url_count", "domain")


def implausible_count(snapshots: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    return snapshots.filter(F.col("url_count") < min_urls).agg(F.count("*").alias("count"))


def snapshot_count(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count("*").alias("remaining_sitemaps"))


def overview(games: DataFrame, sources: DataFrame, snapshots: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """Four counts in one row; each table is read once."""
    of_snapshots = snapshots.agg(
        F.count("*").alias("total_sitemaps"), F.count_if(F.col("url_count") < min_urls).alias("invalid_sitemaps")
    )
    of_sources = sources.agg(F.count("*").alias("total_sources"))
    return (
        games.agg(F.count("*").alias("total_games"))
        .crossJoin(F.broadcast(of_sources))
        .crossJoin(F.broadcast(of_snapshots))
    )


def source_game_ids(sources: DataFrame) -> DataFrame:
    return sources.select("game_id").distinct()


def orphans(games: DataFrame, sources: DataFrame, null_aware: bool = True) -> DataFrame:
    """Games without any source.

    `null_aware` is SQL's NOT IN: one source without a game id makes the result
    empty.  It is written as an anti join and one flag, because Spark runs NOT IN
    itself by broadcasting the whole source list.
    """
    ids = source_game_ids(sources).select(F.col("game_id").alias("id"))
    free = games.join(ids, "id", "left_anti").select(*games.columns)
    if not null_aware:
        return free
    flag = sources.agg(F.coalesce(F.bool_or(F.col("game_id").isNull()), F.lit(False)).alias("_null"))
    return free.crossJoin(F.broadcast(flag)).filter("not _null").select(*games.columns)


def quality_report(games: DataFrame, sources: DataFrame, snapshots: DataFrame, as_of) -> dict[str, DataFrame]:
    def labelled(label: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(label).alias("category"), "*")

    return {
        "implausible_count": labelled("implausible snapshots", implausible_count(snapshots)),
        "implausible": implausible(snapshots),
        "growth": labelled("recent growth", new_per_day(games, as_of)),
        "domains": labelled("games per domain", domain_summary(sources, 20)),
        "today": labelled("new today", new_today(games, as_of)),
        "overview": labelled("overview", overview(games, sources, snapshots)),
    }
