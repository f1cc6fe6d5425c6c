import random

import pytest

from shelfwatch.operators import guards
from shelfwatch.operators.ranking import first_per, first_rows, number_rows, running_number, running_totals, spread_join
from pyspark.sql import functions as F


def counts(spark, n, domain="d"):
    return spark.createDataFrame([(domain, f"u{i % 7}") for i in range(n)], "domain string, url string")


@pytest.mark.parametrize(
    "new, old, status",
    [(0, 5, "zero"), (9, 0, "first_small"), (10, 0, "first_ok"), (49, 100, "shrunk"), (50, 100, "ok"), (1, 2, "ok")],
)
def test_classes(spark, new, old, status):
    row = guards.classify_checks(counts(spark, new), counts(spark, old)).first()
    assert (row.status, row.new_count, row.old_count) == (status, new, old or None)
    assert (row.error == "") == (status in ("ok", "first_ok"))


def sequential(history, initial):
    state = {d: (c, -1) for d, c in initial.items()}
    out = {}
    for domain, run, count in sorted(history):
        base = state.get(domain)
        out[domain, run] = base or (None, None)
        fits = count >= 10 if base is None else count >= base[0] / 2
        if count and fits:
            state[domain] = (count, run)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("span", [1, 5, 4096])
def test_fold_is_sequential(spark, seed, span):
    rnd = random.Random(seed)
    history = [
        (f"d{d}", run, rnd.choice([0, 3, 9, 10, 12, 20, 25, 40, 60, 100, rnd.randint(0, 300)]))
        for d in range(8)
        for run in rnd.sample(range(60), 30)
    ]
    initial = {f"d{d}": rnd.choice([0, 10, 50, 500]) for d in range(0, 8, 2)}
    df = spark.createDataFrame(history, "domain string, run bigint, url_count int")
    base = spark.createDataFrame(list(initial.items()), "domain string, url_count int")
    rows = guards.accepted_baseline(df, base, span=span).collect()
    assert {(r.domain, r.run): (r.baseline, r.baseline_run) for r in rows} == sequential(history, initial)


def test_unguarded_fold_is_the_previous_run(spark):
    runs = spark.createDataFrame([("d", r, 1) for r in (3, 9, 11)], "domain string, run bigint, url_count int")
    rows = guards.fold_accepted(runs, guarded=False, span=4).orderBy("run").collect()
    assert [r.baseline_run for r in rows] == [None, 3, 9]


def test_ranks(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), i, rnd.randint(1, 5)) for i in rnd.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    got = {(r.k, r.o): (r.n, r.t) for r in running_totals(df, ["k"], ["o"], {"n": F.lit(1), "t": F.col("v")}, span=17).collect()}
    for key in "ab":
        total = 0
        for n, (k, o, v) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            total += v
            assert got[k, o] == (n, total)
    assert running_number(df, ["k"], ["o"], span=17).count() == 200
    firsts = first_per(df, ["k"], ["o"]).collect()
    assert {(r.k, r.o, r.v) for r in firsts} == {min(r for r in rows if r[0] == k) for k in "ab"}
    assert first_rows(df, ["k"], ["o"], 3, "n").count() == 6
    numbered = number_rows(df, [F.col("o").desc()], "n").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(200))
    assert [r.o for r in numbered] == sorted((r[1] for r in rows), reverse=True)


def test_spread_join(spark):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, v int")
    small = spark.createDataFrame([("a", "x")], "k string, w string")
    assert spread_join(big, small, ["k"], "inner", ["v"]).count() == 50
    assert spread_join(big, small, ["k"], "left", ["v"]).count() == 51
    assert [r.k for r in spread_join(big, small, ["k"], "left_anti", ["v"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        spread_join(big, small, ["k"], "full_outer", ["v"])
