"""One key that holds all rows: scans, folds and choices stay exact, and no group is larger than its bound."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import guards, ranking, registry, reports
from shelfwatch.streaming import streams
from shelfwatch.workloads import fixtures as fx

MILLION = 1_000_000


def test_one_domain_with_one_feed(spark):
    diff = spark.range(MILLION).select(
        F.lit("d").alias("domain"), F.lit(0).cast("long").alias("feed_ord"), (F.col("id") * 7919 % MILLION).alias("pos"),
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
    )
    got = reports.domain_urls(diff).join(diff.select("url", "pos"), "url")
    row = got.agg(F.count("*").alias("n"), F.count_if(F.col("n") != F.col("pos") + 1).alias("wrong"), F.max("n").alias("last"))
    assert row.first().asDict() == {"n": MILLION, "wrong": 0, "last": MILLION}


def test_pieces_are_bounded(spark):
    """Whatever the order columns hold, a piece of a key has at most `span` rows, and sums go on over pieces and tasks."""
    rows = [("a", x, i) for i, x in enumerate(["", "b", None, "zz", "b"] * 40)] + [("b", "x", 5), ("c", "x", 1)]
    df = spark.createDataFrame(rows, "k string, o string, v long").repartition(5)
    got = ranking.scan_totals(df, ["k"], ["o", "v"], {"n": F.lit(1), "t": F.col("v")}, span=7).collect()
    total = 0
    first = lambda r: (r.o is not None, r.o or "", r.v)
    for n, r in enumerate(sorted((r for r in got if r.k == "a"), key=first), 1):
        total += r.v
        assert (r.n, r.t) == (n, total)
    assert {(r.k, r.n, r.t) for r in got if r.k != "a"} == {("b", 1, 5), ("c", 1, 1)}


def fold(runs):
    state, out = (None, None), []
    for run, count in runs:
        out.append(state)
        if count and (count >= 10 if state[0] is None else count >= state[0] / 2):
            state = (count, run)
    return out


def test_long_history_of_one_domain(spark):
    """Runs in epoch seconds, far apart: spans are cut by the number of runs."""
    pick = np.random.default_rng(4)
    runs = np.cumsum(pick.integers(1, 9000, MILLION)) + 1_700_000_000
    counts = np.maximum(0, (100 * np.exp(np.cumsum(pick.normal(0, 0.4, MILLION)) % 7)).astype(int) - 90)
    df = spark.createDataFrame(pd.DataFrame({"domain": "d", "run": runs, "url_count": counts})).repartition(6)
    got = guards.accepted_baseline(df).toPandas().sort_values("run")
    expected = fold(zip(runs.tolist(), counts.tolist(), strict=True))
    base = [(None, None) if pd.isna(b) else (int(b), int(r)) for b, r in zip(got.baseline, got.baseline_run, strict=True)]
    assert base == expected


@pytest.mark.parametrize("span, fan", [(1, 2), (3, 2), (2, 5)])
def test_tree_of_rounds(spark, span, fan):
    pick = np.random.default_rng(span * 10 + fan)
    rows = [(d, int(r), int(c)) for d in "abc" for r, c in zip(pick.permutation(500)[:90], pick.choice([0, 4, 9, 10, 30, 55, 120], 90), strict=True)]
    df = spark.createDataFrame(rows, "domain string, run long, url_count int")
    got = {(r.domain, r.run): (r.baseline, r.baseline_run) for r in guards.fold_accepted(df, span=span, fan=fan).collect()}
    for d in "abc":
        runs = sorted((r, c) for x, r, c in rows if x == d)
        assert [got[d, r] for r, _ in runs] == fold(runs)


def greedy(edges):
    domains, urls, out = set(), set(), set()
    for _, pos, domain, url in sorted(edges):
        if domain not in domains and url not in urls:
            domains.add(domain)
            urls.add(url)
            out.add((domain, url, pos))
    return out


EDGES = "clean_name string, domain string, url string, feed_ord long, pos long, name string"


def test_million_edges_of_one_name(spark):
    i = F.col("id")
    edges = spark.range(MILLION).select(
        F.lit("x").alias("clean_name"), F.concat(F.lit("d"), (i * 7919 % 5003).cast("string")).alias("domain"),
        F.concat(F.lit("u"), (i * i % 3001).cast("string")).alias("url"), (i % 7).alias("feed_ord"), i.alias("pos"), F.lit("X").alias("name"),
    )
    rows = [(k % 7, k, f"d{k * 7919 % 5003}", f"u{k * k % 3001}") for k in range(MILLION)]
    spark.sparkContext.setJobGroup("settle", "settle")
    got = {(r.domain, r.url, r.pos) for r in registry.settle(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("settle"))
    spark.sparkContext.setJobGroup("", "")
    assert got == greedy(rows) and jobs < 120


@pytest.mark.parametrize("block", [1, 7, 100])
def test_rounds_are_sequential(spark, block):
    pick = np.random.default_rng(block)
    rows = [(n, f"d{a}", f"u{b}", int(f), k, "N") for n in "xy" for k, (a, b, f) in enumerate(pick.integers(0, [9, 12, 4], (120, 3)))]
    got = {(r.clean_name, r.domain, r.url, r.pos) for r in registry.settle(spark.createDataFrame(rows, EDGES), block).collect()}
    assert got == {(n, *e) for n in "xy" for e in greedy([(r[3], r[4], r[1], r[2]) for r in rows if r[0] == n])}


def test_a_batch_touches_its_own_states(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "domain string, run long, url_count long"
    batches = [
        [(f"d{i}", 1, 10 + i) for i in range(50)] + [(None, 1, 12)],
        [("d3", 3, 4), ("d3", 2, 40), ("d4", 2, 3), ("new", 2, 9)],
        [("d3", 1, 25), (None, 2, 7), ("d3", 0, 30)],
    ]
    updated = []
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(landing)
        query = streams.stream_baseline(spark.readStream.schema(schema).parquet(landing), out, state)
        query.awaitTermination()
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]))
    assert updated == [51, 2, 2]
    got = [(r.domain, r.run, r.baseline, r.baseline_run, r.status) for r in spark.read.parquet(f"{out}/checks").collect()]
    late = [(d, r, b, br, s) for d, r, b, br, s in got if (d, r) in {("d3", 0), ("d3", 3), (None, 2), ("new", 2), ("d4", 2)}]
    assert sorted(late, key=str) == sorted(
        [("d3", 0, 40, 2, "ok"), ("d3", 3, 40, 2, "shrunk"), (None, 2, 12, 1, "ok"), ("new", 2, None, None, "first_small"), ("d4", 2, 14, 1, "shrunk")],
        key=str,
    )
    assert [(b, br) for d, r, b, br, _ in got if (d, r) == ("d3", 1)].count((30, 0)) == 1 and len(got) == 58


@pytest.mark.parametrize("first, n", [(0, 3), (700_000, 50), (999_990, 50), (2_000_000, 5)])
def test_deep_pages(spark, first, n):
    """A page far down is found by the row counts of ranges."""
    rows = spark.range(MILLION).select((F.col("id") * 7919 % MILLION).alias("v"))
    got = [r.v for r in ranking.rows_between(rows, [F.col("v").desc()], first, n).orderBy(F.col("v").desc()).collect()]
    assert got == [MILLION - 1 - p for p in range(first, min(first + n, MILLION))]


def test_small_names_are_settled_without_rounds(spark):
    """No row is repeated for a salt, so nothing large can be sent to all tasks."""
    rows = [(f"n{k % 5}", f"d{k % 7}", f"u{k % 3}", k % 2, k, "N") for k in range(60)]
    settled = registry.settle(spark.createDataFrame(rows, EDGES), 100)
    assert "Generate" not in settled._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in settled.inputFiles() if "settled" in f]
    got = {(r.clean_name, r.domain, r.url, r.pos) for r in settled.collect()}
    assert got == {(f"n{n}", *e) for n in range(5) for e in greedy([(r[3], r[4], r[1], r[2]) for r in rows if r[0] == f"n{n}"])}


@pytest.mark.parametrize("batch", [3, 10000])
def test_numbers_go_on_over_tasks(spark, batch):
    """One key over all sorted ranges, small ones beside it, and a null key."""
    pick = np.random.default_rng(batch)
    rows = [(("k", "a", "z", None)[min(3, k % 9)] if k % 9 < 4 else "k", f"d{k % 11}", f"u{k}") for k in pick.permutation(900).tolist()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = ranking.sorted_number(spark.createDataFrame(rows, "key string, domain string, url string"), "key", ["domain", "url"], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in ("k", "a", "z", None):
        expected = sorted(r[1:] for r in rows if r[0] == key)
        assert [(r.domain, r.url) for r in sorted((r for r in got if r.key == key), key=lambda r: r.n)] == expected
        assert sorted(r.n for r in got if r.key == key) == list(range(1, len(expected) + 1))


def test_tasks_of_line_items_follow_the_table(spark, tmp_path, monkeypatch):
    """A fixed number of tasks would group and join a share of the line items that grows with the table."""
    monkeypatch.setattr(fx, "TASK_ROWS", {"lineitem": 100}, raising=False)
    for n in (250, 5000):
        rows = spark.range(n).selectExpr("id AS l_partkey", "id % 7 AS l_suppkey", "1 AS l_linenumber", "'A' AS l_returnflag")
        rows.write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        tasks = fx.table(spark, f"{tmp_path}/{n}", "lineitem").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == n // 100 + 1
        assert sum(r["count"] for r in tasks) == n
