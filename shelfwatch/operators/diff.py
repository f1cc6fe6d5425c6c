"""Which URLs of a catalog are new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .extract import extract_urls


def diff_urls(new: DataFrame, old: DataFrame, keys: Sequence[str] = ("domain", "url")) -> DataFrame:
    """Rows of `new` whose URL the old snapshot of the domain lacks; duplicates are kept.

    The join key holds the URL, so a large site spreads over all tasks; the old
    side is made distinct before the exchange.
    """
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns)


def compare_documents(new_docs: DataFrame, old_docs: DataFrame) -> DataFrame:
    """`diff_urls` over the lenient URLs of two sets of documents."""
    return diff_urls(extract_urls(new_docs, "lenient"), extract_urls(old_docs, "lenient"))


def known_urls(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose URL some source already holds."""
    return urls.join(sources.select("url").distinct(), "url", "left_semi").select(*urls.columns)
