"""Corpus-level extraction from landed catalog documents.

All jobs here are narrow: one pass over the documents, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import slugs
from ..functions.text import ONE_LINE, SPACES, trim_spaces
from ..functions.urls import with_url_parts

STRICT = rf"(?i)<loc>[{SPACES}]*(https?://[^<{SPACES}]+)[{SPACES}]*</loc>"
_LENIENT = rf"(?i)<loc[^>]*>({ONE_LINE}*?)</loc>"
_BLOCK = r"(?is)<url[^>]*>(.*?)</url>"
_LASTMOD = rf"(?i)<lastmod[^>]*>({ONE_LINE}*?)</lastmod>"


def _is_http(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def strict_urls(content: Column) -> Column:
    """URLs of a document in order, duplicates kept, entities left as they are."""
    return F.regexp_extract_all(content, F.lit(STRICT), F.lit(1))


def lenient_urls(content: Column) -> Column:
    """As `strict_urls`, but tags may carry attributes and the text is trimmed."""
    texts = F.regexp_extract_all(content, F.lit(_LENIENT), F.lit(1))
    return F.filter(F.transform(texts, trim_spaces), _is_http)


def url_array(content: Column, mode: str = "strict") -> Column:
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown extraction mode: {mode}")
    return strict_urls(content) if mode == "strict" else lenient_urls(content)


def extract_urls(docs: DataFrame, mode: str = "strict") -> DataFrame:
    """Documents to rows `(..., pos, url)`; every column but `content` is kept."""
    keep = [c for c in docs.columns if c != "content"]
    return docs.select(*keep, F.posexplode(url_array(F.col("content"), mode)).alias("pos", "url"))


def extract_urls_with_lastmod(docs: DataFrame) -> DataFrame:
    """One row per `<url>` block with a URL; `lastmod` is NULL when absent."""
    keep = [c for c in docs.columns if c != "content"]
    blocks = F.regexp_extract_all(F.col("content"), F.lit(_BLOCK), F.lit(1))
    records = F.transform(
        blocks,
        lambda b: F.struct(
            trim_spaces(F.regexp_extract(b, _LENIENT, 1)).alias("url"),
            F.when(b.rlike(_LASTMOD), trim_spaces(F.regexp_extract(b, _LASTMOD, 1))).alias("lastmod"),
        ),
    )
    kept = F.filter(records, lambda r: _is_http(r["url"]))
    return docs.select(*keep, F.posexplode(kept).alias("pos", "r")).select(*keep, "pos", "r.url", "r.lastmod")


def is_valid_sitemap(content: Column) -> Column:
    root = content.rlike(r"(?i)<(?:urlset|sitemapindex)[^>]*>")
    return root & content.rlike(rf"(?i)<loc[^>]*>{ONE_LINE}*?</loc>")


def split_valid_sitemaps(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(valid, rejected)`; a document without content is rejected."""
    valid = F.coalesce(is_valid_sitemap(F.col("content")), F.lit(False))
    return docs.filter(valid), docs.filter(~valid)


def extract_entities(urls: DataFrame, rules: tuple[slugs.SiteRule, ...] = slugs.SITE_RULES) -> DataFrame:
    """URL rows to entity rows `(..., name, clean_name)`; URLs without an entity are dropped.

    Each step is a projection of its own, because its result is used many
    times in the next one.  `inline` over a list of no or one element drops
    rows where a filter would be pushed below the projections and repeat them.
    """
    keep = urls.columns
    parts = with_url_parts(urls, "_host", "_path")
    slug = F.when(
        slugs.is_content_path(F.col("_path")), slugs.site_slug(F.col("_host"), F.col("_path"), rules)
    )
    named = parts.select(*keep, slug.alias("_slug"))
    s = F.col("_slug")
    accepted = slugs.slug_length_ok(s) & slugs.not_category(s) & slugs.not_suffix(s)
    clean = named.select(*keep, "_slug", F.when(accepted, slugs.normalize_name(s)).alias("_clean"))
    entity = F.array(F.struct(s.alias("name"), F.col("_clean").alias("clean_name")))
    return clean.select(*keep, F.inline(F.when(F.length("_clean") >= 2, entity)))
