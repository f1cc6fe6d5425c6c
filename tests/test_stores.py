"""Trigram search, bucketed snapshot URLs and filtered membership, each against its plain form."""

import re

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators.diff import diff_urls
from shelfwatch.operators.name_search import literal_pieces, search_names, write_name_index
from shelfwatch.sources.members import Members
from shelfwatch.sources.url_store import append_urls, diff_stored, url_store

NAMES = ["Red Wagon", "red_wagon", "ROAD 100% Rage", "Ärger im Büro", "ärGER", "a\\b cd", "ab", "", None, "ringring", "Red Wagon"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_literal_pieces():
    assert literal_pieces("%ab_c%") == ["", "ab", "c", ""]
    assert literal_pieces(r"a\%b\_c\\d") == [r"a%b_c\d"]
    assert literal_pieces("%") == ["", ""] and literal_pieces("a\\") == ["a\\"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names"))
    rows = [(None if i == 3 else f"g{i % 9}", n, i, i * 2, -i) for i, n in enumerate(NAMES)]
    rows += [(f"x{i}", f"wagon {i} of {i % 7}", 99 + i, 0, 0) for i in range(300)]
    games = spark.createDataFrame(rows, "id string, name string, n long, _at long, gram long")
    write_name_index(games, path, parts=16)
    return path, games


@pytest.mark.parametrize(
    "search",
    ["red", "RED_W", r"red\_w", "d%wag", "100%", r"100\%", "ÄRGER", "ä", "", "%", "gri", "zzz", "n 17 o", "wagon", r"a\\b c"],
)
def test_search_equals_the_scan(spark, index, search):
    path, games = index
    found = search_names(spark, path, search)
    assert found.columns == games.columns
    expected = games.filter(F.col("name").ilike(f"%{search}%"))
    assert sorted(r.n for r in found.collect()) == sorted(r.n for r in expected.collect())


def test_search_opens_only_places_with_candidates(spark, index):
    path, _ = index
    text = plan(search_names(spark, path, "n 17 o"))
    assert re.search(r"PartitionFilters: \[.*_place", text)


def test_search_in_an_empty_catalog(spark, tmp_path):
    write_name_index(spark.createDataFrame([], "id string, name string"), str(tmp_path))
    assert search_names(spark, str(tmp_path), "abc").collect() == []
    assert search_names(spark, str(tmp_path), "a").columns == ["id", "name"]


def test_stored_side_is_not_shuffled(spark, tmp_path):
    store = url_store(spark, str(tmp_path / "urls"), 8)
    urls = [("hot", f"u{i}") for i in range(4000)] + [("a", "x"), ("a", "y"), ("b", "x"), (None, "x")]
    old = spark.createDataFrame(urls, "domain string, url string")
    append_urls(store, old.unionAll(old), 0, 8)
    append_urls(store, spark.createDataFrame([("a", "y")], old.schema), 1, 8)
    headers = spark.createDataFrame([("hot", 0), ("a", 1), ("b", 0)], "domain string, gen long")
    new = [("hot", f"u{i}", i, "t") for i in range(2000, 6000)]
    new += [("a", "x", 1, "t"), ("a", "x", 2, "t"), ("a", "y", 3, "t"), ("b", "x", 4, "t"), ("c", "x", 5, "t"), (None, "x", 6, "t"), ("b", None, 7, "t")]
    new = spark.createDataFrame(new, "domain string, url string, pos long, gen string")
    found = diff_stored(new, headers, spark.table(store))
    live = spark.table(store).join(headers, ["domain", "gen"], "left_semi")
    assert sorted(found.collect(), key=str) == sorted(diff_urls(new, live).collect(), key=str)
    assert sorted(r.pos for r in found.filter("pos < 10").collect()) == [1, 2, 5, 6, 7]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(diff_stored(new, headers, spark.table(store)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    above, level = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in above)


def test_store_is_found_by_another_session(spark, tmp_path):
    path = str(tmp_path / "urls")
    append_urls(url_store(spark, path, 4), spark.createDataFrame([("a", "x")], "domain string, url string"), 0, 4)
    spark.sql(f"DROP TABLE {url_store(spark, path, 4)}")
    other = url_store(spark.newSession(), path, 4)
    assert [tuple(r) for r in spark.table(other).collect()] == [("a", "x", 0)]


@pytest.mark.parametrize("words", [1, 512])
def test_members(spark, tmp_path, words):
    store = Members(str(tmp_path), parts=8, words=words)
    frame = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "clean_name string, batch long")
    first = frame([f"g{i % 40}" for i in range(200)] + [None, ""])
    assert store.unseen(first, "clean_name", 0).count() == 202
    store.add(first, "clean_name", 0)
    store.add(first, "clean_name", 0)
    store.add(frame([f"h{i}" for i in range(5)]), "clean_name", 1)
    asked = frame(["g1", "g1", "h2", "new", "new", "", None])
    assert sorted(r.batch for r in store.unseen(asked, "clean_name", 2).collect()) == [3, 4, 6]
    assert sorted(r.batch for r in store.unseen(asked, "clean_name", 1).collect()) == [2, 3, 4, 6]
    assert store.unseen(asked, "clean_name", 0).count() == 7
    assert store.unseen(frame([]), "clean_name", 2).count() == 0


def test_members_open_few_partitions(spark, tmp_path):
    store = Members(str(tmp_path), parts=32, words=64)
    names = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("name"))
    store.add(names, "name", 0)
    fresh = spark.range(2000).select(F.concat(F.lit("m"), "id").alias("name"))
    assert store.maybe(names, "name", 1).count() == 2000
    assert store.maybe(fresh, "name", 1).count() < 40
    one = store.maybe(names.filter("name = 'n7'"), "name", 1).collect()
    assert len(one) == 1
    text = plan(store.unseen(names.filter("name = 'n7'"), "name", 1))
    assert re.search(r"PartitionFilters: \[.*part", text)
