"""Landed catalog documents and feed lists."""

from __future__ import annotations

import gzip
import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_host
from ..operators.extract import STRICT, strict_urls
from ..operators.ranking import scan_number, spread_join
from ..session import cut_lineage

OPEN_TAG = "<loc>"
FETCH_META = "path string, feed_ord bigint, feed_url string, status int, error string"


def _key(df: DataFrame) -> DataFrame:
    """Local paths are written with one or three slashes after the scheme."""
    return df.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))


def documents_of(files: DataFrame, fetch_meta: DataFrame, missing: bool = True) -> DataFrame:
    """Files `(path, content)` and what the fetcher recorded per path, to documents.

    With `missing`, a fetch without a file is kept as a document without content.
    """
    meta = _key(fetch_meta.select("path", "feed_ord", "feed_url", "status", "error"))
    joined = meta.join(_key(files.select("path", "content")), "path", "left" if missing else "inner")
    return joined.select(
        "feed_ord", "feed_url", url_host(F.col("feed_url")).alias("domain"), "status", "error", "content"
    )


def land_documents(docs: DataFrame, folder: str, zipped: bool = False) -> DataFrame:
    """Writes the content of every document to a file of its own and gives the fetch records with the files' paths.

    All files lie in one folder, which a reader lists at once, and a task writes many of them.  A task that runs again
    writes other files; those of its first attempt are in no record, so `read_urls` leaves them out.
    """
    uri = re.sub("^(file:)?/+", "file:///", folder)
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)

    def land(content: str | None) -> str:
        name = f"{uuid.uuid4().hex}.txt{'.gz' * zipped}"
        body = (content or "").encode()
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(gzip.compress(body) if zipped else body)
        return f"{uri}/{name}"

    # In batches of rows of Python's own, so that no batch holds more than a hundred bodies.
    landed = F.udf(land, "string", useArrow=False).asNondeterministic()
    rest = [c for c in docs.columns if c != "content"]
    return cut_lineage(docs.select(landed("content").alias("path"), *rest))


def read_documents(spark: SparkSession, path: str, fetch_meta: DataFrame) -> DataFrame:
    """One row per landed file; `.gz` files are unpacked by the reader.

    One file is one row, so landed files stay within the 50 MB that the sitemap
    protocol allows a document; `read_urls` has no such bound.  `fetch_meta.path` is
    the file's full URI.
    """
    files = spark.read.text(path, wholetext=True)
    return documents_of(
        files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")), fetch_meta
    )


def read_urls(spark: SparkSession, path: str, fetch_meta: DataFrame) -> DataFrame:
    """The URLs (strict rule) of landed files of any size: `(feed_ord, feed_url, domain, status, error, pos, url)`.

    Files are read in records that begin behind a `<loc>` tag, so a plain file is split over several tasks and
    no document is ever one row; a URL never crosses a record.  What stands before the first tag of a file is
    no record of that kind, so a URL at its very start does not count.  Only narrow URL rows are numbered and
    joined with the fetch records; files without a record are left out.
    """
    source = F.col("_metadata")
    records = spark.read.text(path, lineSep=OPEN_TAG).select(
        source["file_path"].alias("path"), source["file_block_start"].alias("block"), "value"
    )
    body = F.concat(F.lit(OPEN_TAG), F.col("value"))
    urls = records.select(
        "path",
        "block",
        F.monotonically_increasing_id().alias("record"),
        body.rlike(f"^{STRICT}").alias("at_start"),
        F.posexplode_outer(strict_urls(body)).alias("k", "url"),
    )
    urls = cut_lineage(urls)
    heads = urls.filter("block = 0").groupBy("path").agg(F.min("record").alias("head"))
    rows = urls.filter("url is not null").join(heads, "path", "left")
    in_head = (F.col("block") == 0) & (F.col("record") == F.col("head")) & F.col("at_start") & (F.col("k") == 0)
    rows = rows.filter(~F.coalesce(in_head, F.lit(False))).select("path", "block", "record", "k", "url")
    numbered = scan_number(rows, ["path"], ["block", "record", "k"], "n")
    meta = _key(fetch_meta.select("path", "feed_ord", "feed_url", "status", "error"))
    found = spread_join(_key(numbered), meta, ["path"], "inner", ["url"])
    return found.select(
        "feed_ord", "feed_url", url_host(F.col("feed_url")).alias("domain"), "status", "error", (F.col("n") - 1).alias("pos"), "url"
    )


def decode_feed_list(df: DataFrame, col: str = "value") -> DataFrame:
    """A JSON array of urls to rows `(..., feed_ord, url)`; missing or broken JSON is an empty list."""
    urls = F.coalesce(F.from_json(F.col(col), "array<string>"), F.array().cast("array<string>"))
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(urls).alias("feed_ord", "url")).withColumn(
        "feed_ord", F.col("feed_ord").cast("bigint")
    )
