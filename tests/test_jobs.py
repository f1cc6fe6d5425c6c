import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators.extract import strict_urls
from shelfwatch.operators.feeds import feed_order
from shelfwatch.plans.full_run import commit_run, full_run, load_state
from shelfwatch.sources import tables
from shelfwatch.sources.documents import decode_feed_list, land_documents, read_documents, read_urls
from shelfwatch.sources.request_logs import extract_to_csv, request_rows
from shelfwatch.streaming import streams
from shelfwatch.workloads import fixtures as fx
from shelfwatch.workloads import jobs
from shelfwatch.workloads.jobs import known_games

META = "path string, feed_ord bigint, feed_url string, status int, error string"


def land(folder, name, slugs):
    body = "<urlset>" + "".join(f"<url><loc>https://h/games/{s}</loc></url>\n" for s in slugs) + "</urlset>"
    path = folder / name
    path.write_bytes(gzip.compress(body.encode()) if name.endswith(".gz") else body.encode())
    return path.as_uri().replace("file:///", "file:/")


def names(n, start=0):
    return [f"game-{i}" for i in range(start, start + n)]


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a = land(tmp_path / "in", "a.xml", names(2))
    b = land(tmp_path / "in", "b.xml.gz", names(3))
    files = {r[0] for r in spark.read.text(str(tmp_path / "in"), wholetext=True).select("_metadata.file_path").collect()}
    uri = {f.rsplit("/", 1)[1]: f for f in files}
    meta = spark.createDataFrame(
        [(uri["a.xml"], 0, "https://a/s.xml", 200, None), (uri["b.xml.gz"], 1, "https://b/s.xml.gz", 200, None), ("none", 2, "https://c/s.xml", 503, None)],
        META,
    )
    rows = {r.domain: r for r in read_documents(spark, str(tmp_path / "in"), meta).collect()}
    assert a and b and rows["a"].content.count("<loc>") == 2 and rows["b"].content.count("<loc>") == 3
    assert rows["c"].content is None and rows["c"].status == 503


def test_feed_list(spark):
    df = spark.createDataFrame([(0, '["u1","u2"]'), (1, "[broken"), (2, None)], "k int, value string")
    assert [(r.k, r.feed_ord, r.url) for r in decode_feed_list(df).orderBy("feed_ord").collect()] == [(0, 0, "u1"), (0, 1, "u2")]


def rows_of(spark, *payloads):
    df = spark.createDataFrame([(json.dumps(p),) for p in payloads], "value string")
    return sorted((r.ip, r.time) for r in request_rows(df).collect())


def test_request_rows(spark):
    items = [{"ip": "1", "time": "t"}, {"ip": 2}, {"ip": None, "time": "n"}, 7, "x", [], None]
    assert rows_of(spark, {"data": {"inParams": items}}) == [("", "n"), ("1", "t"), ("2", "")]
    assert rows_of(spark, [], 5, {}, {"data": []}, {"data": {}}, {"data": {"inParams": []}}) == []
    with pytest.raises(Exception, match="not an array"):
        rows_of(spark, {"data": {"inParams": {"ip": "1"}}})


def test_csv(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text(json.dumps({"data": {"inParams": [{"ip": "1", "time": "a,b"}, {"time": "t"}]}}))
    extract_to_csv(spark, str(tmp_path / "log"), str(tmp_path / "csv"))
    lines = [f.read_text().splitlines() for f in (tmp_path / "csv").glob("part-*")]
    assert lines == [["ip,time", '1,"a,b"', ",t"]]


def docs(spark, *rows):
    schema = "feed_ord bigint, feed_url string, domain string, status int, error string, content string"
    body = lambda ns: "".join(f"<loc>https://h/games/{n}</loc>" for n in ns)
    return spark.createDataFrame([(i, f"https://{d}/s.xml", d, 200, None, body(ns)) for i, (d, ns) in enumerate(rows)], schema)


def test_runs_over_tables(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.create_tables(spark, root)
    assert tables.table_exists(spark, root, "games") and tables.read_table(spark, root, "games").isEmpty()

    def run(at, *rows):
        gen = tables.next_gen(spark, root)
        result = full_run(docs(spark, *rows), load_state(spark, root), at, gen)
        commit_run(spark, root, gen, result)
        return result

    first = run("2024-01-01", ("a", names(10)), ("b", names(12)))
    assert first.changes.isEmpty() and first.report["totals"].first().processed == 2
    second = run("2024-01-02", ("a", names(12)), ("b", names(11, 2)))
    # Both sites gain game-10 or more; the same URL under two sites counts once.
    got = sorted((r.domain, r.name, r.is_new) for r in second.changes.collect())
    assert got == [("a", "game-10", True), ("a", "game-11", True), ("b", "game-12", True)]
    again = run("2024-01-03", ("a", names(12)), ("b", names(11, 2)))
    assert again.changes.isEmpty() and again.diff.isEmpty()
    third = run("2024-03-01", ("a", names(2)), ("b", names(14)))
    assert {r.domain: r.check_status for r in third.checks.collect()} == {"a": "shrunk", "b": "ok"}
    assert third.report["cleaned"].first().deleted == 2
    assert {r.domain: r.url_count for r in tables.read_table(spark, root, "snapshots").collect()} == {"a": 12, "b": 14}
    assert tables.read_table(spark, root, "snapshot_urls").count() == 26
    tables.compact_snapshot_urls(spark, root)
    assert tables.read_table(spark, root, "snapshot_urls").count() == 26
    assert tables.read_table(spark, root, "update_logs").count() == 1
    tables.reset_tables(spark, root)
    assert tables.read_table(spark, root, "games").isEmpty() and tables.read_table(spark, root, "snapshot_urls").isEmpty()


def test_stream_of_landed_files(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "tables")
    landing.mkdir()

    def meta(session):
        rows = [(f"file://{landing}/{f.name}", i, "https://a/s.xml", 200, None) for i, f in enumerate(sorted(landing.iterdir()))]
        return session.createDataFrame(rows, META)

    def run():
        files = streams.landing_stream(spark, str(landing))
        streams.stream_diff(files, root, str(tmp_path / "cp"), meta, lambda b: f"2024-01-{b + 1:02d}").awaitTermination()

    land(landing, "1.xml", names(10))
    run()
    land(landing, "2.xml.gz", names(12))
    run()
    run()
    assert tables.read_table(spark, root, "snapshots").first().url_count == 12
    assert sorted(r.name for r in tables.read_table(spark, root, "games").collect()) == ["game-10", "game-11"]
    assert tables.last_batch(spark, root) == 1


def test_stream_first_seen(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "clean_name string, feed_ord bigint, pos bigint, url string"
    for start, stop in ((50, 100), (0, 60)):
        rows = [(f"g{i % 7}", 1, i, f"u{i}") for i in range(start, stop)] + [("late", 0, start, "v")]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(landing)
        streams.stream_first_seen(spark.readStream.schema(schema).parquet(landing), out, state).awaitTermination()
    got = sorted((r.clean_name, r.pos) for r in spark.read.parquet(out).collect())
    assert got == sorted([(f"g{i % 7}", i) for i in range(50, 57)] + [("late", 50)])


def test_closed_days_drop_late_rows(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for days in (["2024-02-20", "2024-02-21"], ["2024-01-01", "2024-02-21"]):
        rows = spark.createDataFrame([(f"{x} 12:00:00",) for x in days], "ts string").selectExpr("cast(ts as timestamp) ts")
        rows.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        streams.stream_daily_counts(stream, out, state).awaitTermination()
    got = {str(r.date): r.n for r in streams.read_daily_counts(spark, out).collect()}
    assert got == {"2024-02-20": 1, "2024-02-21": 2}


def test_feed_order_is_stable_over_partitions(spark):
    df = spark.range(1000).repartition(7).select(
        F.concat(F.lit("https://x/"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("url"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int") % 10)).alias("created_at"),
    )
    rows = feed_order(df).orderBy("feed_ord").collect()
    assert [r.feed_ord for r in rows] == list(range(1000))
    assert [(r.created_at, r.url) for r in rows] == sorted((r.created_at, r.url) for r in rows)


def test_urls_of_documents_in_records(spark, tmp_path):
    """Files are read in records over several tasks; the URLs and their order are those of the whole text."""
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {
        "big.xml": "<urlset>\n" + "".join(
            f"<url><loc>{' ' * (i % 3)}https://h/games/g-{i}\n</loc></url>" + ("<URL><LOC>http://H/up</LOC></URL>" if i % 5 == 0 else "") for i in range(4000)
        ),
        "headless.xml": "https://no.start/a</loc><loc>https://h/b</loc>",
        "starts.xml": "<loc>https://h/c</loc><loc>ftp://h/d</loc><loc>https://h/e",
        "none.xml": "<urlset></urlset>",
        "odd.xml": "<loc a='b'>https://h/f</loc><LOC>https://h/g</LOC><loc><![CDATA[https://h/h]]></loc>",
    }
    for name, text in texts.items():
        (folder / name).write_text(text)
    (folder / "packed.xml.gz").write_bytes(gzip.compress(texts["big.xml"].encode()))
    texts["packed.xml.gz"] = texts["big.xml"]
    (folder / "blank.xml").write_text("")
    names = sorted([*texts, "blank.xml"])
    meta = spark.createDataFrame([((folder / n).as_uri(), i, f"https://{n}/s.xml", 200, None) for i, n in enumerate(names)], META)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_urls(spark, str(folder), meta).orderBy("feed_ord", "pos").collect()
        assert spark.read.text(str(folder), lineSep="<loc>").rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    whole = re.compile(r"<loc>\s*(https?://[^<\s]+)\s*</loc>", re.I)
    expected = [(i, pos, url) for i, n in enumerate(names) for pos, url in enumerate(whole.findall(texts.get(n, "")))]
    assert [(r.feed_ord, r.pos, r.url) for r in got] == expected
    assert {r.domain for r in got} == {"big.xml", "packed.xml.gz", "headless.xml", "starts.xml", "odd.xml"}


def test_no_exchange_carries_bodies(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<loc>https://h/a</loc>")
    meta = spark.createDataFrame([], META)
    plan = read_urls(spark, str(tmp_path), meta)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "value" not in plan


def test_known_games_have_one_row_per_clean_name(spark):
    rows = [("ench", "Ench", "a"), ("ench", "ench", "b"), ("ench", "ench.", "b"), ("was", "was", "a")]
    known = spark.createDataFrame(rows, "clean_name string, name string, domain string")
    games = known_games(known.withColumn("listed_at", F.lit("2024-01-01").cast("timestamp_ntz")))
    assert sorted((g.clean_name, g.name, g.platform_count) for g in games.collect()) == [("ench", "Ench", 2), ("was", "was", 1)]


def test_landed_documents_of_odd_pages(spark, tmp_path):
    """Negative, null and repeated page ids; each document is one file of a single folder, which is listed at once."""
    rows = [(i, f"https://h{i}.example.com/p", f'<a href="/x{i}">x</a>') for i in (-3, -2, 0, 1, 1)]
    rows += [(None, "https://n.example.com/", "none"), (5, "https://e.example.com/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted(map(tuple, jobs.landed_documents(spark, str(tmp_path)).collect()), key=repr)
    docs = fx.page_docs(spark, str(tmp_path))
    expected = docs.select("feed_ord", "domain", "status", F.posexplode(strict_urls(F.col("content"))).alias("pos", "url"))
    assert found == sorted(map(tuple, expected.collect()), key=repr)
    meta = land_documents(docs, str(tmp_path / "landed"))
    assert len(list((tmp_path / "landed").glob("*.txt"))) == meta.select("path").distinct().count() == len(rows)
