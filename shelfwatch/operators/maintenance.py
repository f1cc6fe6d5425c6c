"""Retention and cleanup as new table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import timestamp
from .quality import MIN_URLS, days_before, orphans


def retain_logs(logs: DataFrame, as_of, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """`(kept, deleted)`: rows older than `days` go, rows without a time stay."""
    old = F.coalesce(F.col("checked_at") < days_before(as_of, days), F.lit(False))
    return logs.filter(~old), logs.agg(F.count_if(old).alias("deleted"))


def purge_snapshots(snapshots: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """Implausible snapshots go, so that their domains start again with a first check."""
    return snapshots.filter(~F.coalesce(F.col("url_count") < min_urls, F.lit(False)))


def purge_domain(sources: DataFrame, domain: str) -> DataFrame:
    return sources.filter(~F.coalesce(F.col("domain") == domain, F.lit(False)))


def purge_since(sources: DataFrame, ts) -> DataFrame:
    return sources.filter(~F.coalesce(F.col("first_seen") > timestamp(ts), F.lit(False)))


def purge_orphans(games: DataFrame, sources: DataFrame, null_aware: bool = True) -> DataFrame:
    gone = orphans(games, sources, null_aware).select("id")
    return games.join(gone, "id", "left_anti").select(*games.columns)


def cascade_delete(sources: DataFrame, deleted_games: DataFrame) -> DataFrame:
    """Sources of deleted games go with them."""
    ids = deleted_games.select(F.col("id").alias("game_id"))
    return sources.join(ids, "game_id", "left_anti").select(*sources.columns)
