import pytest

from shelfwatch.operators import extract


def docs(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "doc int, content string")


def urls(df):
    return [r.url for r in df.orderBy("doc", "pos").collect()]


XML = """<urlset>
<url><loc>https://a.com/1</loc></url>
<url><LOC> HTTPS://a.com/2 </LOC></url>
<url><loc a="b">https://a.com/3</loc></url>
<url><loc>
https://a.com/4
</loc></url>
<url><loc><![CDATA[https://a.com/5]]></loc></url>
<url><loc>https://a.com/6?a=1&amp;b=2</loc></url>
<url><loc>https://a.com/1</loc></url>
<url><loc> https://a.com/7 </loc></url>
<url><loc>https://a.com/8 x</loc></url>
</urlset>"""


def test_strict(spark):
    got = urls(extract.extract_urls(docs(spark, XML)))
    assert got == [
        "https://a.com/1", "HTTPS://a.com/2", "https://a.com/4", "https://a.com/6?a=1&amp;b=2", "https://a.com/1",
        "https://a.com/7",
    ]


def test_lenient(spark):
    got = urls(extract.extract_urls(docs(spark, XML), "lenient"))
    assert got == [
        "https://a.com/1", "https://a.com/3", "https://a.com/6?a=1&amp;b=2", "https://a.com/1", "https://a.com/7",
        "https://a.com/8 x",
    ]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        extract.extract_urls(docs(spark, XML), "other")


def test_lastmod(spark):
    xml = (
        "<urlset><url><loc>https://a.com/1</loc><lastmod> 2024-01-01 </lastmod></url>"
        "<url>\n<loc>https://a.com/2</loc>\n</url><url><loc>https://a.com/3</loc><lastmod></lastmod></url>"
        "<url><loc>ftp://a.com/4</loc></url><url><lastmod>2024</lastmod></url></urlset>"
    )
    rows = extract.extract_urls_with_lastmod(docs(spark, xml)).orderBy("pos").collect()
    assert [(r.pos, r.url, r.lastmod) for r in rows] == [
        (0, "https://a.com/1", "2024-01-01"),
        (1, "https://a.com/2", None),
        (2, "https://a.com/3", ""),
    ]


def test_valid(spark):
    df = docs(
        spark,
        "<urlset><loc>x</loc></urlset>",
        "<SitemapIndex a='b'><loc></loc></SitemapIndex>",
        "<urlset><loc>\n</loc></urlset>",
        "<html><loc>x</loc></html>",
        "<urlset></urlset>",
        None,
    )
    valid, rejected = extract.split_valid_sitemaps(df)
    assert sorted(r.doc for r in valid.collect()) == [0, 1]
    assert sorted(r.doc for r in rejected.collect()) == [2, 3, 4, 5]


ENTITIES = {
    "https://poki.com/en/g/subway-surfers": "subway-surfers",
    "https://poki.com/en/g/subway-surfers/": None,
    "https://poki.com/en/x": None,
    "https://www.coolmathgames.com/0-run-3": "run-3",
    "https://www.coolmathgames.com/run-3": None,
    "https://dev.itch.io/my-thing": "my-thing",
    "https://dev.itch.io/jam": None,
    "https://dev.itch.io/Jam": "Jam",
    "https://itch.io/my-thing": None,
    "https://www.kongregate.com/games/someone/thing": "thing",
    "https://www.kongregate.com/games/thing": None,
    "https://armorgames.com/play/thing": "thing",
    "https://armorgames.com/Play/thing": None,
    "https://www.newgrounds.com/portal/view/123": "newgrounds-123",
    "https://www.newgrounds.com/portal/view/12a": None,
    "https://www.miniclip.com/games/thing": "thing",
    "https://www.miniclip.com/games/genre": None,
    "https://www.y8.com/games/thing": "thing",
    "https://www.friv.com/game/thing": "thing",
    "https://x.com/games/thing": "thing",
    "https://x.com/Games/thing.html": "thing",
    "https://x.com/games/thing.HTML": "thing.HTML",
    "https://x.com/a/thing-game": "thing",
    "https://x.com/thing.html": "thing",
    "https://x.com/a/b/thing.HTM": "thing",
    "https://x.com/thing": "thing",
    "https://x.com/thing/": None,
    "https://x.com/a/b": None,
    "https://x.com/": None,
    "https://x.com/en": None,
    "https://x.com/EN/": None,
    "https://x.com/tag/games/thing": None,
    "https://x.com/a/about/thing": None,
    "https://x.com/about": None,
    "https://x.com/blog/thing": None,
    "https://x.com/sitemap.xml": None,
    "https://x.com/feed": None,
    "https://x.com/feedback": "feedback",
    "https://x.com/thing.png": None,
    "https://x.com/Action-Games": None,
    "https://x.com/games/fun-games": None,
    "https://x.com/games/squid-games": "squid-games",
    "https://x.com/games/Hunger-Game": "Hunger-Game",
    "https://x.com/g/a": None,
    "https://x.com/g/ab": "ab",
    "https://x.com/g/" + "a" * 100: "a" * 100,
    "https://x.com/g/" + "a" * 101: None,
    "https://x.com/g/--!": None,
    "notaurl": None,
}


def test_entities(spark):
    df = spark.createDataFrame([(u,) for u in ENTITIES], "url string")
    got = {r.url: r.name for r in extract.extract_entities(df).collect()}
    assert got == {u: n for u, n in ENTITIES.items() if n}


def test_clean_names(column):
    from shelfwatch.functions.slugs import normalize_name

    names = ["Some_Thing  2", "--a--b--", "Ünï-code", "a-!-b", "A B", "!!"]
    assert column(normalize_name, names) == ["some-thing-2", "a-b", "n-code", "a-b", "a-b", ""]
