"""Snapshot URLs in a bucketed table, so that the stored side of a diff is never shuffled.

Rows are bucketed by domain, URL and generation.  A run appends the URLs of the domains it accepts
under its own generation; the header of a domain names the generation that counts.  A diff attaches
that generation to the new rows, which travel anyway, so stored rows are met in their buckets
and rows of older generations match nothing.
"""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import spread_join

KEY = ("domain", "url", "gen")
BUCKETS = 64


def url_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """The catalog name of the store at `path`, which this session learns if need be.

    `buckets` is fixed when a store is created: later sessions must name the same number.
    """
    name = f"url_store_{sha1(path.encode()).hexdigest()[:16]}_{buckets}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (domain STRING, url STRING, gen BIGINT) USING parquet "
        f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def append_urls(store: str, urls: DataFrame, gen: int, buckets: int = BUCKETS) -> None:
    """Adds the distinct `domain, url` of a run as generation `gen`, one file per bucket.

    The rows are dealt by the hash of the buckets, so a large domain spreads over all of them.
    """
    rows = urls.select("domain", "url").distinct().withColumn("gen", F.lit(gen).cast("long"))
    writer = rows.repartition(buckets, *KEY).write.mode("append").format("parquet")
    writer.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(store)


def diff_stored(new: DataFrame, headers: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of `new` whose URL the live snapshot of the domain lacks; duplicates are kept.

    `headers(domain, gen)` has one row per domain with a snapshot.  A domain without one is all
    new; a null domain or URL equals no stored one.  One domain may own most rows of `new`.
    """
    live = headers.select("domain", F.col("gen").alias("_gen"))
    dated = spread_join(new, live, ["domain"], "left", ["url"])
    old = stored.select(*[F.col(c).alias(f"_old_{c}") for c in KEY])
    same = (F.col("domain") == F.col("_old_domain")) & (F.col("url") == F.col("_old_url")) & (F.col("_gen") == F.col("_old_gen"))
    return dated.join(old, same, "left_anti").select(*new.columns)
