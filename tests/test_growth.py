"""Steps whose time or memory must not grow faster than the tables."""

import importlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import urls
from shelfwatch.functions.slugs import normalize_name
from shelfwatch.operators import dashboard, guards, name_search, registry
from shelfwatch.operators.extract import extract_entities
from shelfwatch.session import cut_lineage, spread_rows
from shelfwatch.sources import members, tables
from shelfwatch.streaming.streams import baseline_checks
from shelfwatch.workloads import changes
from shelfwatch.workloads import fixtures as fx

DOCS = "feed_ord long, feed_url string, domain string, status int, error string, content string"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plain_urls_are_cut_as_the_rules_say(spark):
    plain = ["http://a/", "https://a.b-c.com/games/x-1A", "http://a.com//x/", "http://a.com/x@y:z|~[b]"]
    others = ["http://a.com", "http://1.2.3.4/x", "http://A.com/x", "http://a.com/x/../y", "http://a.com/%2e/x", "https:///x/y", "http://a.com/x\n", None]
    df = spark.createDataFrame([(u,) for u in plain + others], "url string")
    tested = df.filter(F.col("url").rlike(urls._PLAIN_URL))
    assert {r.url for r in tested.collect()} == set(plain)
    for r in urls.with_url_parts(df).withColumns({"h": urls.written_host(F.col("url")), "p": urls.url_path(F.col("url"))}).collect():
        assert (r.host, r.path) == (r.h, r.p)


def test_slugs_of_other_sites(spark):
    paths = {
        "/games/a1.html": "a1", "/GAMES/b1.htm": "b1", "/games/a.HTML": "a.HTML", "/x/y/abc-game": "abc", "/x/ABC-GAME": "ABC",
        "/x/.htm": None, "/games/.html": None, "/abc": "abc", "/a/b": None, "//abc": None, "/xplay/abc": None, "/x/abc.htm-game": "abc",
    }
    df = spark.createDataFrame([("http://s.com" + p,) for p in paths], "url string")
    found = {r.url[12:]: r.name for r in extract_entities(df).collect()}
    assert found == {p: n for p, n in paths.items() if n}


def test_normal_names_are_not_replaced(column):
    names = ["red-fox-1A", "a--b", "-a", "a_b c", "abc\n", "ÄB", "", None]
    assert column(normalize_name, names) == ["red-fox-1a", "a-b", "a", "a-b-c", "abc", "b", "", None]


def test_checks_of_a_domain_leave_python_as_one_row(spark, tmp_path):
    rows = [("a", 3, 20), ("a", 1, 12), ("a", 2, None), ("a", 2, 5), ("b", 1, 3)]
    spark.createDataFrame(rows, "domain string, run long, url_count long").write.parquet(str(tmp_path / "in"))
    checks = baseline_checks(spark.readStream.schema("domain string, run long, url_count long").parquet(str(tmp_path / "in")))
    assert "Generate inline" in plan(checks)
    query = checks.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    found = {(r.domain, r.run, r.url_count): (r.baseline, r.baseline_run) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {("a", 1, 12): (None, None), ("a", 2, 5): (12, 1), ("a", 2, None): (12, 1), ("a", 3, 20): (12, 1), ("b", 1, 3): (None, None)}


def test_first_occurrences_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setitem(fx.TASK_ROWS, "lineitem", 1000)
    text = plan(changes.first_occurrences(spark, "/root/testdata/sf0.001"))
    assert re.search(r"hashpartitioning\(clean_name#\d+, domain#\d+, [4-9]\), REPARTITION_BY_NUM", text)


@pytest.mark.parametrize("sent,text", [(1 << 19, "5), REPARTITION_BY_NUM"), (1, "35), REPARTITION_BY_NUM")])
def test_members_deal_probes_by_rows(spark, tmp_path, monkeypatch, sent, text):
    monkeypatch.setattr(members, "TASK_ROWS", 500)
    monkeypatch.setattr(members, "SENT_WORDS", sent)
    store = members.Members(str(tmp_path), parts=4, words=64)
    names = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("name"))
    store.add(names, "name", 0)
    store.add(names.limit(1500), "name", 1)
    maybe = store.maybe(names, "name", 2)
    assert text in plan(maybe) and maybe.count() == 2000
    assert store.unseen(names.union(spark.createDataFrame([("m",), (None,)], "name string")), "name", 2).count() == 2


def test_hexadecimal_ids_travel_as_bytes(spark):
    ids = ["0a" * 16, "0A" * 16, "a", "ab", "", "\n", "ab\n", "é", None]
    games = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, n int")
    sources = spark.createDataFrame([(i, "d", f"u{n}") for n, i in enumerate(ids)], "game_id string, domain string, url string")
    nested = dashboard.nested(games, sources)
    assert nested.columns == ["id", "n", "game_sources"] and "unhex" in plan(nested)
    for r in nested.collect():
        assert r.id == ids[r.n] and [s.url for s in r.game_sources] == ([] if r.id is None else [f"u{r.n}"])


def test_name_postings_are_lists(spark, tmp_path):
    names = ["Red Wagon", "wagon red", "ÄRGER ärger", "日本", "ab", "", None, "x" * 50_000] + [f"wagon {i}" for i in range(400)]
    games = spark.createDataFrame([(f"g{i % 50}", n, i) for i, n in enumerate(names)], "id string, name string, n int")
    path = str(tmp_path)
    name_search.write_name_index(games.repartition(5), path, parts=3)
    postings = spark.read.parquet(f"{path}/postings")
    # 'wag' in 402 names is one list per place and block, not 402 rows.
    wag = postings.filter(F.col("gram") == int.from_bytes(b"wag", "big")).agg(F.count("*"), F.sum("n"), F.countDistinct("_place")).first()
    assert wag[0] == wag[2] < 10 and wag[1] == 402
    assert spark.read.parquet(f"{path}/counts").agg(F.sum("n")).first() == postings.agg(F.sum("n")).first()
    text = plan(name_search.search_names(spark, path, "wagon"))
    assert "Join" not in text and "_place" in text
    for search in ("wagon", "n 17", "ÄRGER", "本", "日_", "xxx", "gon_r", "b"):
        found = name_search.search_names(spark, path, search)
        assert sorted(r.n for r in found.collect()) == sorted(r.n for r in games.filter(F.col("name").ilike(f"%{search}%")).collect())


def test_name_blocks_keep_every_row():
    names = ["abcabc", "xbcd", "日本", "abc"] * 50
    rows = pa.RecordBatch.from_pydict(
        {"name": names, "_place": pa.array([i // 90 for i in range(200)], pa.int32()), "_key": pa.array([(i * 7) % 200 for i in range(200)], pa.int32())}
    )
    for size in (1, 100, 1 << 22):
        out = list(name_search.inverter(size)(iter([rows.slice(0, 0), rows.slice(3, 120), rows.slice(123)])))
        found = []
        for batch in out:
            listed = name_search.lister()(iter([batch.select(["_place", "keys"])]))
            for gram, n, keys in zip(batch.column("gram").to_pylist(), batch.column("n").to_pylist(), listed, strict=True):
                assert n == keys.num_rows
                found += [(gram, p, k) for p, k in zip(*(c.to_pylist() for c in keys.columns), strict=True)]
        whole = [(g, i // 90, (i * 7) % 200) for i in range(3, 200) for g in name_search.trigrams(names[i])]
        assert sorted(found) == sorted(whole)


def test_plain_urls_with_queries(spark):
    plain = ["http://a.b/x?ref=feed", "https://a.b/en/1#top", "http://a.b/?q=/y/../z\\%2e ", "http://a.b/x#?é", "http://a.b/x?\n"]
    others = ["http://a.b?x/y", "http://a.b/é?x", "http://u@a.b/x?y", "http://a.b:80/x?y", "http://a.b/%2e/?x"]
    df = spark.createDataFrame([(u,) for u in plain + others], "url string")
    assert {r.url for r in df.filter(F.col("url").rlike(urls._PLAIN_URL)).collect()} == set(plain)
    for r in urls.with_url_parts(df).withColumns({"h": urls.written_host(F.col("url")), "p": urls.url_path(F.col("url"))}).collect():
        assert (r.host, r.path) == (r.h, r.p)


@pytest.mark.parametrize("piece", [1, 3, 64])
@pytest.mark.parametrize("guarded", [True, False])
def test_spans_are_scanned_in_pieces(spark, monkeypatch, piece, guarded):
    monkeypatch.setattr(guards, "PIECE", piece)
    counts = [(i * 7919) % 101 if i % 9 else 0 for i in range(200)]
    rows = [("a", r, c) for r, c in enumerate(counts)] + [("b", 5, 20), ("b", 9, None), ("b", 11, 12)]
    df = spark.createDataFrame(rows, "domain string, run long, url_count long")
    folded = guards.fold_accepted(df, guarded=guarded)
    text = folded._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in text and "flatten(" in text
    got = {(r.domain, r.run): (r.url_count, r.baseline, r.baseline_run) for r in folded.collect()}
    for domain in "ab":
        state = (None, None)
        for _, run, count in [r for r in rows if r[0] == domain]:
            assert got[domain, run] == (count, *state)
            if not guarded or count and (count >= 10 if state[0] is None else count >= state[0] * 0.5):
                state = (count, run)


def test_entities_of_a_run_are_extracted_in_tasks_by_rows(spark, tmp_path, monkeypatch):
    run, spread = importlib.import_module("shelfwatch.plans.full_run"), []
    monkeypatch.setattr(run, "spread_rows", lambda df: spread.append(spread_rows(df, 5)) or spread[-1])
    old, new = ("".join(f"<loc>https://a/games/game-{i}</loc>" for i in range(n)) for n in (10, 25))
    for gen, content in enumerate((old, new)):
        docs = spark.createDataFrame([(1, "https://a/s.xml", "a", 200, None, content)], DOCS)
        result = run.full_run(docs, run.load_state(spark, str(tmp_path)), f"2024-01-0{gen + 1}", gen)
        run.commit_run(spark, str(tmp_path), gen, result)
    assert [s.rdd.getNumPartitions() for s in spread] == [1, 4] and result.changes.count() == 15


def test_missing_tables_start_no_workers(spark, tmp_path):
    games = tables.read_table(spark, str(tmp_path), "games")
    assert games.schema == tables.TABLES["games"] and games.count() == 0
    assert "RDD" not in plan(games) and "LocalRelation <empty>" in games._jdf.queryExecution().optimizedPlan().toString()


def test_shared_urls_move_their_texts_once(spark, monkeypatch):
    """Candidates are dealt by clean name and decided there, not grouped, joined and numbered by name, site and URL in turn."""
    cut = []
    monkeypatch.setattr(registry, "cut_lineage", lambda df: cut.append(df) or cut_lineage(df))
    monkeypatch.setattr(registry, "BLOCK", 1000)
    found = changes.entity_changes_shared_urls(spark, "/root/testdata/sf0.001")
    moved = [x for df in [*cut, found] for x in re.findall(r"Exchange (\w+\(.*)", df._jdf.queryExecution().executedPlan().toString())]
    assert [x for x in moved if re.search(r"clean_name|domain|url", x)] == [x for x in moved if "clean_name" in x and "REPARTITION_BY_NUM" in x]
    assert len([x for x in moved if "clean_name" in x]) == 1 and len(cut) <= 6
    assert found.count() > 5000
