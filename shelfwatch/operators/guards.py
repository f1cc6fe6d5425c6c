"""Plausibility guards and the fold over the last accepted count.

A check is compared with the last *accepted* check of its domain, so what counts
as the baseline depends on all earlier decisions.  The runs of a domain are counted off
into spans of at most `SPAN`, and each span is summarised on its own:

    a check of count c is accepted from baseline b  <=>  c > 0 and c >= shrink * b

Let m be the largest count of a span.  From any baseline b with m >= shrink * b the
check of count m is accepted, whatever came before it in the span, so all such b
leave the span with the same state; from a larger b every check of the span is
rejected and b stays.  A span is therefore described by three values (m, the state
it is left with, and the same for "no baseline yet").  Neighbouring spans have the same
description, so they are merged in a tree of rounds, and the states they are entered with
come back down: a domain with very many runs is folded in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import number_rows

MIN_FIRST = 10
SHRINK = 0.5
SPAN = 4096
FAN = 64
PIECE = 64


def check_status(new_count: Column, old_count: Column, min_first: int = MIN_FIRST, shrink: float = SHRINK) -> Column:
    """zero, first_small, first_ok, shrunk or ok; `old_count` is NULL without a baseline."""
    return (
        F.when(new_count == 0, "zero")
        .when(old_count.isNull() & (new_count < min_first), "first_small")
        .when(old_count.isNull(), "first_ok")
        .when((old_count > 0) & (new_count < old_count * shrink), "shrunk")
        .otherwise("ok")
    )


def status_error(status: Column, new_count: Column, old_count: Column) -> Column:
    """Message of a failed check, empty on success."""
    n, o = new_count.cast("string"), old_count.cast("string")
    return (
        F.when(status == "zero", F.lit("no URL found in the document"))
        .when(status == "first_small", F.concat(F.lit("too few URLs in first check: "), n))
        .when(status == "shrunk", F.concat(F.lit("implausible URL count: new="), n, F.lit(", old="), o))
        .otherwise(F.lit(""))
    )


def is_success(status: Column) -> Column:
    return status.isin("ok", "first_ok")


def classify_checks(
    new: DataFrame, old: DataFrame, min_first: int = MIN_FIRST, shrink: float = SHRINK
) -> DataFrame:
    """One row per domain of either snapshot; counts include duplicates.

    Both sides are counted by one aggregate over their union, which combines
    before the exchange.  A domain without old rows has no baseline.
    """
    rows = new.select("domain", F.lit(1).alias("n"), F.lit(0).alias("o")).unionByName(
        old.select("domain", F.lit(0).alias("n"), F.lit(1).alias("o"))
    )
    counts = rows.groupBy("domain").agg(F.sum("n").alias("new_count"), F.sum("o").alias("_o"))
    old_count = F.when(F.col("_o") > 0, F.col("_o"))
    status = check_status(F.col("new_count"), old_count, min_first, shrink)
    return counts.select("domain", old_count.alias("old_count"), "new_count", status.alias("status")).withColumn(
        "error", status_error(F.col("status"), F.col("new_count"), F.col("old_count"))
    )


_STATE = "struct<c:bigint,run:bigint>"


def _none() -> Column:
    return F.lit(None).cast(_STATE)


def _zero() -> Column:
    """A baseline that every check with URLs passes."""
    return F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(-1).cast("bigint").alias("run")).cast(_STATE)


def _step(guarded: bool, min_first: int, shrink: float):
    """Next state after one check."""

    def step(state: Column, x: Column) -> Column:
        taken = F.struct(x["c"].alias("c"), x["run"].alias("run")).cast(_STATE)
        if not guarded:
            return taken
        plausible = F.when(state.isNull(), x["c"] >= min_first).otherwise(x["c"] >= state["c"] * shrink)
        return F.when((x["c"] > 0) & plausible, taken).otherwise(state)

    return step


def _leave(guarded: bool, shrink: float):
    """Next state after a whole span, from its summary."""

    def leave(state: Column, s: Column) -> Column:
        if not guarded:
            return s["r"]
        moved = F.when((s["m"] > 0) & (s["m"] >= state["c"] * shrink), s["r"]).otherwise(state)
        return F.when(state.isNull(), s["n"]).otherwise(moved)

    return leave


def fold_accepted(
    history: DataFrame,
    initial: DataFrame | None = None,
    min_first: int = MIN_FIRST,
    shrink: float = SHRINK,
    guarded: bool = True,
    span: int = SPAN,
    fan: int = FAN,
) -> DataFrame:
    """`history(domain, run, url_count)`, one row per domain and integer run, to
    `(domain, run, url_count, baseline, baseline_run)`: the state before each run.

    `initial(domain, url_count)` holds baselines from before; their run is -1.
    With `guarded=False` every check is accepted, so the baseline is the previous run.
    Runs are counted off into spans of at most `span`, whatever their numbers; up to `fan` neighbours are
    merged per round until a domain has no more than `fan` of them, and states are handed down the same way.
    """
    step = _step(guarded, min_first, shrink)
    leave = _leave(guarded, shrink)
    rows = history.select("domain", F.col("run"), F.col("url_count").cast("bigint").alias("c"))
    placed = number_rows(rows, [F.col("domain"), F.col("run")], "at")
    spans = placed.groupBy("domain", F.floor(F.col("at") / span).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("run", "c"))).alias("xs")
    )
    levels = [
        cut_lineage(
            spans.select(
                "domain",
                "part",
                F.array_max(F.transform("xs", lambda x: x["c"])).alias("m"),
                F.aggregate("xs", _zero(), step).alias("r"),
                F.aggregate("xs", _none(), step).alias("n"),
            )
        )
    ]
    most = levels[0].groupBy("domain").count().agg(F.max("count")).first()[0] or 0
    while most > fan:
        merged = _neighbours(levels[-1], fan).select(
            "domain",
            "part",
            F.array_max(F.transform("ss", lambda s: s["m"])).alias("m"),
            F.aggregate("ss", _zero(), leave).alias("r"),
            F.aggregate("ss", _none(), leave).alias("n"),
        )
        levels.append(cut_lineage(merged))
        most = (most - 2) // fan + 2  # cut at fixed places, so both ends may be partly filled

    top = levels[-1].groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("part", "m", "r", "n"))).alias("ss"))
    if initial is not None:
        state = F.struct(F.col("url_count").cast("bigint").alias("c"), F.lit(-1).cast("bigint").alias("run"))
        base = initial.select("domain", state.cast(_STATE).alias("before"))
        entered = top.join(base, "domain", "left")
    else:
        entered = top.withColumn("before", _none())
    for level in [*levels[-2::-1], None]:
        before = _scan("ss", F.col("before"), leave, lambda s: s["part"])
        starts = entered.select("domain", F.inline(before)).select("domain", F.col("key").alias("part"), "before")
        below = spans if level is None else _neighbours(level, fan)
        entered = below.join(starts, ["domain", "part"])
    inside = _scan("xs", F.col("before"), step, lambda x: x["run"], lambda x: x["c"])
    return entered.select("domain", F.inline(inside)).select(
        "domain",
        F.col("key").alias("run"),
        F.col("val").alias("url_count"),
        F.col("before.c").alias("baseline"),
        F.col("before.run").alias("baseline_run"),
    )


def _neighbours(level: DataFrame, fan: int) -> DataFrame:
    """Summaries of up to `fan` neighbouring parts of a domain, in order, under the number of their parent."""
    return level.groupBy("domain", F.floor(F.col("part") / fan).alias("parent")).agg(
        F.sort_array(F.collect_list(F.struct("part", "m", "r", "n"))).alias("ss")
    ).withColumnRenamed("parent", "part")


def _scan(xs: str, init: Column, step, key, value=lambda x: F.lit(None)) -> Column:
    """List of `(key, val, before)`: the state before each element of `xs`.

    Every element copies the list made so far, so long lists are cut into pieces of `PIECE`: the states before the
    pieces are found first, then those inside each.
    """
    inside = lambda piece, state: _states(piece, state, step, key, value)
    starts = F.sequence(F.lit(1), F.size(xs), F.lit(PIECE))
    pieces = F.transform(starts, lambda i: F.struct(F.slice(xs, i, PIECE).alias("p")))
    through = lambda state, x: F.aggregate(x["p"], state.cast(_STATE), step)
    entered = _states(pieces, init, through, lambda x: F.lit(None))
    both = F.zip_with(pieces, entered, lambda x, e: inside(x["p"], e["before"]))
    return F.when(F.size(xs) <= PIECE, inside(F.col(xs), init)).otherwise(F.flatten(both))


def _states(xs: Column, init: Column, step, key, value=lambda x: F.lit(None)) -> Column:
    out_type = f"array<struct<key:bigint,val:bigint,before:{_STATE}>>"
    zero = F.struct(init.cast(_STATE).alias("s"), F.array().cast(out_type).alias("out"))

    def merge(acc: Column, x: Column) -> Column:
        row = F.struct(
            key(x).cast("bigint").alias("key"), value(x).cast("bigint").alias("val"), acc["s"].alias("before")
        )
        return F.struct(
            step(acc["s"], x).cast(_STATE).alias("s"), F.concat(acc["out"], F.array(row)).cast(out_type).alias("out")
        )

    return F.aggregate(xs, zero, merge, lambda acc: acc["out"])


def accepted_baseline(
    history: DataFrame,
    initial: DataFrame | None = None,
    min_first: int = MIN_FIRST,
    shrink: float = SHRINK,
    span: int = SPAN,
) -> DataFrame:
    """`(domain, run, url_count, baseline, baseline_run, status, accepted)` for every run."""
    folded = fold_accepted(history, initial, min_first, shrink, True, span)
    status = check_status(F.col("url_count"), F.col("baseline"), min_first, shrink)
    return folded.withColumn("status", status).withColumn("accepted", is_success(F.col("status")))
