"""Run reports.

`diff` rows are `(feed_ord, domain, pos, url)`.  Order of appearance is
(feed_ord, pos); lists of URLs stay rows with a running number, so that a large
site never becomes one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_host, with_url_parts
from .maintenance import retain_logs
from .ranking import first_rows, running_number, scan_number

# Path segments that are not keywords.
PLAIN_SEGMENTS = ("index", "page", "post", "article", "news", "blog")


def new_urls(diff: DataFrame) -> DataFrame:
    """All new URLs of the run in feed order."""
    return diff.select("feed_ord", "pos", "domain", "url").orderBy("feed_ord", "pos")


def by_domain(checks: DataFrame, diff: DataFrame) -> DataFrame:
    """`(domain, total_new, first_feed)`; domains of successful feeds without news stay, with 0."""
    domains = checks.filter("success").groupBy("domain").agg(F.min("feed_ord").alias("first_feed"))
    totals = diff.groupBy("domain").agg(F.count("*").alias("total_new"))
    return domains.join(totals, "domain", "left").select(
        "domain", F.coalesce("total_new", F.lit(0)).alias("total_new"), "first_feed"
    )


def domain_urls(diff: DataFrame) -> DataFrame:
    """The URL list of each domain: `(domain, n, url)`."""
    rows = diff.select("domain", "feed_ord", "pos", "url")
    return scan_number(rows, ["domain"], ["feed_ord", "pos", "url"]).select("domain", "n", "url")


def active_domains(totals: DataFrame) -> DataFrame:
    return totals.filter("total_new > 0")


def ranked_domains(totals: DataFrame) -> DataFrame:
    """Domains with news, most first; ties in feed order."""
    return active_domains(totals).orderBy(F.col("total_new").desc(), "first_feed")


def domain_samples(diff: DataFrame, n: int = 3) -> DataFrame:
    """`(domain, total_new, samples, remaining)`: the first `n` URLs and how many are left."""
    first = first_rows(diff.select("domain", "feed_ord", "pos", "url"), ["domain"], ["feed_ord", "pos", "url"], n, "k")
    samples = first.groupBy("domain").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "url"))), lambda s: s["url"]).alias("samples")
    )
    totals = diff.groupBy("domain").agg(F.count("*").alias("total_new"))
    return totals.join(samples, "domain").select(
        "domain", "total_new", "samples", F.greatest(F.col("total_new") - n, F.lit(0)).alias("remaining")
    )


def feed_notice(diff: DataFrame, n: int | None = None) -> DataFrame:
    """Numbered URLs per feed, the first `n` or all: `(feed_ord, domain, no, url, total, remaining)`."""
    rows = diff.select("feed_ord", "domain", "pos", "url")
    if n is None:
        numbered = running_number(rows, ["feed_ord"], ["pos", "url"], "no")
    else:
        numbered = first_rows(rows, ["feed_ord"], ["pos", "url"], n, "no")
    totals = diff.groupBy("feed_ord").agg(F.count("*").alias("total"))
    shown = F.col("total") if n is None else F.lit(n)
    return numbered.join(totals, "feed_ord").select(
        "feed_ord", "domain", "no", "url", "total", F.greatest(F.col("total") - shown, F.lit(0)).alias("remaining")
    )


# --- keywords --------------------------------------------------------------


def _segments(path: Column, at_least: int) -> Column:
    return F.filter(F.split(path, "/", -1), lambda s: F.length(s) >= at_least)


def _tokens(urls: DataFrame, tokens: Column) -> DataFrame:
    keep = [c for c in ("feed_ord", "pos", "url") if c in urls.columns]
    parts = with_url_parts(urls.select(*keep), "_host", "_path").filter("_host is not null")
    return parts.select(*keep, F.posexplode(tokens).alias("seg", "keyword"))


def keyword_tokens(urls: DataFrame) -> DataFrame:
    """`(feed_ord, pos, url, seg, keyword)`: path segments with dashes removed, in lower case."""
    plain = "^(?i:" + "|".join(PLAIN_SEGMENTS) + ")$"
    kept = F.filter(_segments(F.col("_path"), 3), lambda s: ~s.rlike(r"^\d+$|\." + "|" + plain))
    words = F.filter(
        F.transform(kept, lambda s: F.lower(F.replace(s, F.lit("-"), F.lit("")))), lambda w: F.length(w) > 2
    )
    return _tokens(urls, words)


def simple_tokens(urls: DataFrame) -> DataFrame:
    """Segments longer than three characters without a dash, case kept."""
    return _tokens(urls, F.filter(_segments(F.col("_path"), 4), lambda s: ~s.contains("-")))


def _first_seen(name: str) -> Column:
    return F.min(F.struct("feed_ord", "pos", "seg")).alias(name)


def keyword_counts(urls: DataFrame) -> DataFrame:
    """`(keyword, count, first)` of every keyword."""
    return keyword_tokens(urls).groupBy("keyword").agg(F.count("*").alias("count"), _first_seen("first"))


def top_keywords(urls: DataFrame, n: int = 10, with_count: bool = True) -> DataFrame:
    """The `n` most frequent keywords; ties in order of appearance."""
    top = keyword_counts(urls).orderBy(F.col("count").desc(), "first").limit(n)
    return top.select("keyword", "count") if with_count else top.select("keyword")


def distinct_keywords(urls: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` distinct simple tokens in order of appearance."""
    seen = simple_tokens(urls).groupBy("keyword").agg(_first_seen("first"))
    return seen.orderBy("first").limit(n)


def host_distribution(urls: DataFrame) -> DataFrame:
    """URLs per host, most first; invalid URLs are skipped."""
    hosts = urls.select(url_host(F.col("url")).alias("domain"), "feed_ord", "pos").filter("domain is not null")
    counts = hosts.groupBy("domain").agg(F.count("*").alias("count"), F.min(F.struct("feed_ord", "pos")).alias("first"))
    return counts.orderBy(F.col("count").desc(), "first").select("domain", "count")


# --- totals ----------------------------------------------------------------


def first_domains(totals: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The first `n` domains with news in feed order, and `others`: all domains beyond `n`,
    with or without news."""
    shown = active_domains(totals).orderBy("first_feed", "domain").limit(n).select("domain", "total_new", "first_feed")
    others = totals.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("others"))
    return shown, others


def run_totals(checks: DataFrame, changes: DataFrame, rule: str = "v2") -> DataFrame:
    """One row of run totals from `checks(success[, threw, timeout])`.

    v2, scheduled: every feed that did not throw is processed, a failed one is an error too.
    manual: only feeds that threw are errors.  chat: success, error and timeout counts and
    the progress in percent.  `changes` are registry changes for v2, new URLs otherwise.
    """
    threw = F.col("threw") if "threw" in checks.columns else F.lit(False)
    timeout = F.col("timeout") if "timeout" in checks.columns else F.lit(False)
    success = F.col("success")
    failed = ~success
    if rule == "chat":
        totals = checks.agg(
            F.count("*").alias("feeds"),
            F.count_if(success).alias("success"),
            F.count_if(failed).alias("errors"),
            F.count_if(failed & timeout).alias("timeouts"),
            F.count_if(~threw).alias("_processed"),
        ).withColumn("progress", F.coalesce(progress(F.col("_processed"), F.col("feeds")), F.lit(0))).drop("_processed")
    elif rule in ("v2", "scheduled", "manual"):
        errors = threw if rule == "manual" else (threw | failed)
        totals = checks.agg(
            F.count("*").alias("feeds"), F.count_if(~threw).alias("processed"), F.count_if(errors).alias("errors")
        )
    else:
        raise ValueError(f"unknown rule: {rule}")
    if rule == "v2":
        news = changes.agg(F.count_if("is_new").alias("new_games"), F.count_if("is_cross").alias("cross_platform"))
    else:
        news = changes.agg(F.count("*").alias("new_urls"))
    return totals.crossJoin(F.broadcast(news))


def progress(processed: Column, total: Column) -> Column:
    """Rounded percentage."""
    return F.round(F.try_divide(processed * 100, total)).cast("int")


def changes_by_domain(changes: DataFrame) -> DataFrame:
    """New and cross-platform entities per domain; domains without any do not appear."""
    return changes.groupBy("domain").agg(
        F.count_if("is_new").alias("new_games"), F.count_if("is_cross").alias("cross_platform")
    )


# --- composed reports ------------------------------------------------------


def unified_report(checks: DataFrame, diff: DataFrame, rule: str = "scheduled") -> dict[str, DataFrame]:
    samples = domain_samples(diff).select("domain", "samples", "remaining")
    ranked = active_domains(by_domain(checks, diff)).join(samples, "domain")
    return {
        "summary": run_totals(checks, diff, rule),
        "domains": ranked.orderBy(F.col("total_new").desc(), "first_feed"),
        "keywords": top_keywords(diff),
    }


def keyword_report(diff: DataFrame) -> dict[str, DataFrame]:
    return {
        "total": diff.agg(F.count("*").alias("total_new")),
        "keywords": top_keywords(diff),
        "hosts": host_distribution(diff),
    }


def embed_report(checks: DataFrame, diff: DataFrame, rule: str = "scheduled", n: int = 10) -> dict[str, DataFrame]:
    shown, others = first_domains(by_domain(checks, diff), n)
    summary = run_totals(checks, diff, rule).withColumn("has_news", F.col("new_urls") > 0)
    return {"summary": summary.crossJoin(F.broadcast(others)), "domains": shown}


def keyword_digest(checks: DataFrame, diff: DataFrame, n: int = 10) -> DataFrame:
    """One row: chat totals and the first distinct keywords joined by commas."""
    first = distinct_keywords(diff, n)
    words = first.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "keyword"))), lambda k: k["keyword"]), ", ").alias(
            "keywords"
        )
    )
    return run_totals(checks, diff, "chat").crossJoin(F.broadcast(words))


def run_report(checks: DataFrame, changes: DataFrame, logs: DataFrame, as_of, days: int = 30) -> dict[str, DataFrame]:
    """Totals, per-domain changes and the number of logs that retention removes."""
    return {
        "totals": run_totals(checks, changes, "v2"),
        "domains": changes_by_domain(changes),
        "cleaned": retain_logs(logs, as_of, days)[1],
    }
