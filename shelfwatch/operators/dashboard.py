"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import platform_tier, score_tier
from ..session import cut_lineage
from .ranking import first_rows, rows_between, sorted_number


def stats(games: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row from one pass over each table.  `total_platforms` counts feed rows."""
    of_games = games.agg(
        F.count("*").alias("total_games"),
        F.count_if(F.col("platform_count") >= 2).alias("cross_platform_games"),
        F.count_if(F.col("score") >= 2.0).alias("high_score_games"),
    )
    return of_games.crossJoin(F.broadcast(feeds.agg(F.count("*").alias("total_platforms"))))


def high_score(games: DataFrame) -> DataFrame:
    return games.filter(F.col("score") >= 2.0)


def numbered_sources(sources: DataFrame) -> DataFrame:
    """All sources with their number `n` inside the game, by domain and URL, from 1: one row each."""
    return sorted_number(sources.select("game_id", "domain", "url"), "game_id", ["domain", "url"], "n").select(
        "game_id", "n", "domain", "url"
    )


def nested(games: DataFrame, sources: DataFrame, first_sources: int | None = None) -> DataFrame:
    """Games with the list of all their sources by domain and URL, empty when there are none.

    One row per game, whatever its number of sources; `first_sources` shows only the first so
    many, and `numbered_sources` has them as rows.
    """
    shown = sources.select("game_id", "domain", "url")
    if first_sources is not None:
        shown = first_rows(shown, ["game_id"], ["domain", "url"], first_sources, "n")
    lists = shown.groupBy(_packed("game_id").alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("domain", "url"))).alias("game_sources")
    )
    empty = F.array().cast("array<struct<domain:string,url:string>>")
    packed = games.select(_packed("id").alias("_key"), *[c for c in games.columns if c != "id"])
    return packed.join(lists, "_key", "left").select(
        *[_unpacked("_key").alias(c) if c == "id" else F.col(c) for c in games.columns],
        F.coalesce("game_sources", empty).alias("game_sources"),
    )


def _packed(c: str) -> Column:
    """A text id as bytes for an exchange: hexadecimal ids, which no codec makes smaller, take half; a first byte tells which."""
    plain = F.concat(F.lit(b"\x00"), F.encode(c, "UTF-8"))
    return F.when(F.col(c).rlike(r"^(?:[0-9a-f]{2})+\z"), F.concat(F.lit(b"\x01"), F.unhex(c))).otherwise(plain)


def _unpacked(key: str) -> Column:
    rest = F.substr(F.col(key), F.lit(2), F.length(key) - 1)
    return F.when(F.substr(F.col(key), F.lit(1), F.lit(1)) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def _best_order() -> list[Column]:
    return [F.col("score").desc_nulls_first(), F.col("first_seen").desc_nulls_first(), F.col("clean_name")]


def _newest_best(games: DataFrame) -> DataFrame:
    return games.orderBy(*_best_order())


def games_page(
    games: DataFrame,
    sources: DataFrame,
    min_platforms: int | None = None,
    search: str | None = None,
    domain: str | None = None,
    limit: int | None = None,
    offset: int | None = None,
    domain_before_paging: bool = False,
) -> DataFrame:
    """The rows of a page, before their sources are nested.

    With an offset the page size is `limit` or 50, and the page is found by its place, so that
    the rows before it are not collected.  By default the domain filter applies to the finished
    page, so a page may be short.
    """
    rows = games
    if min_platforms:
        rows = rows.filter(F.col("platform_count") >= min_platforms)
    if search:
        rows = rows.filter(F.col("name").ilike(f"%{search}%"))
    of_domain = sources.filter(F.col("domain") == domain).select(F.col("game_id").alias("id")) if domain else None
    if domain and domain_before_paging:
        rows = rows.join(of_domain, "id", "left_semi").select(*games.columns)
    if offset:
        page = rows_between(rows, _best_order(), offset, limit or 50)
    else:
        page = _newest_best(rows).limit(limit) if limit else _newest_best(rows)
    if domain and not domain_before_paging:
        page = page.join(of_domain, "id", "left_semi").select(*games.columns)
    return page


def games(catalog: DataFrame, sources: DataFrame, **filters) -> DataFrame:
    """A page of games with nested sources.

    A limited page is settled first, so only its games' sources are nested.
    """
    page = games_page(catalog, sources, **filters)
    if filters.get("limit") or filters.get("offset"):
        page = cut_lineage(page)
        sources = sources.join(page.select(F.col("id").alias("game_id")), "game_id", "left_semi")
    return _newest_best(nested(page, sources))


def top_games(catalog: DataFrame, sources: DataFrame, n: int = 20) -> DataFrame:
    return games(catalog, sources, min_platforms=2, limit=n)


def dashboard_top(catalog: DataFrame, sources: DataFrame) -> DataFrame:
    return games(catalog, sources, min_platforms=2, limit=6)


def count_shown(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("id").alias("shown"))


def card(df: DataFrame) -> DataFrame:
    """Display columns of a game."""
    return df.select(
        "name",
        "clean_name",
        "platform_count",
        F.format_number(F.col("score").cast("double"), 1).alias("score_text"),
        score_tier(F.col("score")).alias("score_tier"),
        platform_tier(F.col("platform_count")).alias("platform_tier"),
        (F.col("score").cast("double") / 2.5 * 100).alias("bar"),
        (F.col("platform_count") >= 2).alias("is_cross"),
        F.to_date("first_seen").alias("first_seen_on"),
    )
