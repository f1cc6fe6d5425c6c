import random

import pytest

from shelfwatch.operators import snapshots
from shelfwatch.schemas import SNAPSHOT_URLS, SNAPSHOTS

AT = "2024-01-05 08:00:00"
DOCS = "feed_ord bigint, feed_url string, domain string, status int, error string, content string"
STATE = "domain string, current string, latest string, last_update string"


def xml(urls):
    return "<urlset>" + "\n".join(f"<loc>https://x.com/{u}</loc>" for u in urls) + "</urlset>"


def doc(feed, domain, urls, status=200, error=None):
    content = None if urls is None else (urls if isinstance(urls, str) else xml(urls))
    return (feed, f"https://{domain}/sitemap{feed}.xml", domain, status, error, content)


def check(spark, docs, headers=(), urls=()):
    return snapshots.snapshot_check(
        spark.createDataFrame(docs, DOCS),
        spark.createDataFrame(list(headers), SNAPSHOTS),
        spark.createDataFrame(list(urls), SNAPSHOT_URLS),
        AT,
        gen=7,
    )


def test_check_branches(spark):
    stored = [("old", 0, 4, None), ("small", 0, 100, None), ("kept", 0, 3, None)]
    old_urls = [("old", i, f"https://x.com/{i}") for i in range(4)] + [("kept", 0, "https://x.com/k")]
    docs = [
        doc(0, "old", [1, 2, 9, 9]),
        doc(1, "fresh", range(10)),
        doc(2, "tiny", range(9)),
        doc(3, "none", "<urlset></urlset>"),
        doc(4, "gone", None, 404),
        doc(5, "late", None, None, "timeout"),
        doc(6, "small", range(49)),
    ]
    result = check(spark, docs, stored, old_urls)
    rows = {r.domain: r for r in snapshots.with_new_counts(result.checks, result.diff).collect()}
    assert {d: r.check_status for d, r in rows.items()} == {
        "old": "ok", "fresh": "first_ok", "tiny": "first_small", "none": "zero", "gone": "fetch_error",
        "late": "fetch_error", "small": "shrunk",
    }
    assert (rows["gone"].error, rows["late"].error, rows["old"].error) == ("HTTP 404", "timeout", "")
    assert [(r.domain, r.pos, r.url) for r in result.diff.orderBy("pos").collect()] == [
        ("old", 2, "https://x.com/9"), ("old", 3, "https://x.com/9"),
    ]
    assert (rows["old"].new_urls, rows["fresh"].new_urls, rows["fresh"].total_urls) == (2, 0, 10)
    headers = {r.domain: (r.gen, r.url_count) for r in result.snapshots.collect()}
    assert headers == {"old": (7, 4), "fresh": (7, 10), "small": (0, 100), "kept": (0, 3)}
    kept = {}
    for r in result.snapshot_urls.collect():
        kept.setdefault(r.domain, []).append(r.url)
    assert {d: len(u) for d, u in kept.items()} == {"old": 4, "fresh": 10, "kept": 1}


def test_feeds_of_one_domain_follow_each_other(spark):
    docs = [doc(0, "d", range(10)), doc(1, "d", [1, 2]), doc(2, "d", range(5, 20)), doc(3, "d", range(19, 40))]
    result = check(spark, docs)
    statuses = [r.check_status for r in result.checks.orderBy("feed_ord").collect()]
    assert statuses == ["first_ok", "shrunk", "ok", "ok"]
    news = {}
    for r in result.diff.collect():
        news.setdefault(r.feed_ord, set()).add(int(r.url.rsplit("/", 1)[1]))
    assert news == {2: set(range(10, 20)), 3: set(range(20, 40))}
    assert {int(r.url.rsplit("/", 1)[1]) for r in result.advanced_urls.collect()} == set(range(19, 40))


def daily(docs, state, today, force):
    """Feeds one after the other over a table of documents per domain."""
    state = {d: dict(zip(("current", "latest", "day"), v)) for d, v in state.items()}
    out = {}

    def minus(a, b):
        held = set(b.split())
        return [u for u in a.split() if u not in held]

    for feed, domain, status, content in docs:
        s = state.setdefault(domain, {"current": None, "latest": None, "day": None})
        if not force and s["day"] == today:
            both = s["current"] and s["latest"]
            out[feed] = ("same_day_news", minus(s["current"], s["latest"])) if both else ("same_day", [])
        elif status != 200:
            out[feed] = ("fetch_error", [])
        else:
            news = minus(content, s["current"]) if s["current"] else []
            out[feed] = ("fetched", news)
            s["latest"] = s["current"] or s["latest"]
            s["current"], s["day"] = content, today
    return out, {d: (s["current"], s["latest"]) for d, s in state.items() if s["day"]}


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_daily_rule_is_sequential(spark, seed, force):
    rnd = random.Random(seed)

    def text():
        return "" if rnd.random() < 0.2 else " ".join(rnd.sample("abcdefgh", rnd.randint(1, 6)))

    docs = [(f, f"d{rnd.randint(0, 5)}", rnd.choice([200, 200, 500]), text()) for f in range(20)]
    state = {
        f"d{i}": (text(), rnd.choice([None, text()]), rnd.choice(["20240105", "20240104"])) for i in range(4)
    }
    tag = lambda t: None if t is None else "".join(f"<loc>https://x/{u}</loc>" for u in t.split())
    df = spark.createDataFrame([(f, f"https://{d}/{f}", d, s, None, tag(t)) for f, d, s, t in docs], DOCS)
    st = spark.createDataFrame([(d, tag(c), tag(l), y) for d, (c, l, y) in state.items()], STATE)
    result = snapshots.daily_check(df, st, AT, force)
    outcomes, final = daily(docs, state, "20240105", force)
    assert {r.feed_ord: r.outcome for r in result.checks.collect()} == {f: o for f, (o, _) in outcomes.items()}
    news = {}
    for r in result.diff.orderBy("feed_ord", "pos").collect():
        news.setdefault(r.feed_ord, []).append(r.url.removeprefix("https://x/"))
    assert news == {f: n for f, (_, n) in outcomes.items() if n}
    got = {r.domain: (r.current, r.latest or None) for r in result.state.collect()}
    assert got == {d: (tag(c), tag(l) or None) for d, (c, l) in final.items()}


def test_rotation(spark):
    old = spark.createDataFrame([("a", "A0", "A1", "d0"), ("b", "", "B1", "d0"), ("c", "C0", None, "d0")], STATE)
    new = spark.createDataFrame([("a", "A2"), ("b", "B2"), ("n", "N2")], "domain string, content string")
    state, dated = snapshots.rotate_snapshots(old, new, AT)
    assert {tuple(r) for r in state.collect()} == {
        ("a", "A2", "A0", "20240105"), ("b", "B2", "B1", "20240105"), ("c", "C0", None, "d0"), ("n", "N2", None, "20240105"),
    }
    assert {tuple(r) for r in dated.collect()} == {("a", "20240105", "A2"), ("b", "20240105", "B2"), ("n", "20240105", "N2")}


def test_lookup_kinds(spark):
    rows = spark.createDataFrame(
        [("a", "current", "20240105"), ("a", "dated", "20240105"), ("a", "dated", "20240104")], "domain string, kind string, date string"
    )
    assert snapshots.lookup_by_kind(rows).count() == 1
    assert snapshots.lookup_by_kind(rows, "dated", "20240104").first().date == "20240104"
    assert snapshots.lookup_by_kind(rows, "dated", as_of=AT).first().date == "20240105"
    assert snapshots.lookup_by_kind(rows, "other").isEmpty()
