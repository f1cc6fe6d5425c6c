"""Mixing of sources to target weights by weighted fair queueing.

Every document, shuffled inside its source, gets a virtual finish time: the source's words
up to and including it over the source's target.  All documents are range-sorted by that
time and cut at the total budget.  A document that is under way when its source reaches its
target queues as two packets, cut there, so a source misses its target by less than a word
before the rest of the budget, under one word per source, is handed out in the same order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import number_rows, running_totals, spread_join
from ..session import cut_lineage
from .rows import bring_back, set_aside

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3


def words(text: str = "text"):
    """Number of words of a text; none in a null one."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Rank, size and target of every source of a table with `source` and `size`.

    The weights repeat over the sources by code point, null last.  A target is weight x level,
    at most `repeats` times the source's size, where the one level makes the targets sum to
    the total size: what capped sources leave is shared by weight among the others.  The
    level is found over the sources in the order in which they reach their cap.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(kinds, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    by_cap = number_rows(ranked, [F.col("cap") / F.col("weight"), F.col("rank")], "place")
    sums = {"caps": F.col("cap"), "weights": F.col("weight")}
    summed = running_totals(by_cap, [], ["place"], sums)
    total = summed.agg(F.sum("source_size").cast("double").alias("_total"), F.sum("weight").alias("_all"))
    left = F.col("_total") - F.col("caps") + F.col("cap")
    level = left / (F.col("_all") - F.col("weights") + F.col("weight"))
    found = summed.crossJoin(F.broadcast(total)).withColumn("_level", level)
    found = found.filter(F.col("_level") <= F.col("cap") / F.col("weight"))
    one = found.agg(F.min_by("_level", "place").alias("_level"))
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce("_level", F.lit(0.0)))
    return ranked.crossJoin(F.broadcast(one)).select("source", "rank", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    seed: int = 4,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Adds `size`, `source_size`, `target` and `taken` to `doc_id, source`, one row per input row.

    `taken` is the number of words that the mix takes from the row, repeats counted: a source
    whose target exceeds its size is passed over again, in the same order, up to `repeats`
    times; a row at the target's or the budget's edge is taken in part.  Null texts have size 0 and are
    never taken; a null source is a source of its own, the last; rows with equal ids are told
    apart by their sizes and otherwise alike.  An empty table gives no rows.  Of the other columns
    only those named in `carry` are read and returned.
    """
    sized = cut_lineage(docs.select("doc_id", "source", *carry, words().alias("size")))
    targets = cut_lineage(source_targets(sized, weights, repeats))
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    known = spread_join(
        sized.withColumn("_key", key), targets.withColumn("_key", key).drop("source"), ["_key"], "left", ["doc_id"]
    ).drop("_key")
    shuffled = F.xxhash64(F.lit(seed), "doc_id", "size")
    placed = number_rows(known, [F.col("rank"), shuffled, F.col("doc_id"), F.col("size")], "place")
    placed = cut_lineage(running_totals(placed, ["rank"], ["place"], {"upto": F.col("size")}))
    copies = placed.filter("size > 0 and target > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch")
    )
    start = F.col("epoch") * F.col("source_size") + F.col("upto") - F.col("size")
    before = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start))
    halves = F.array(
        F.struct(before.alias("size"), (start + before).alias("end")),
        F.struct((F.col("size") - before).alias("size"), (start + F.col("size")).alias("end")),
    )
    packets = copies.select("place", "epoch", "rank", "target", F.inline(halves)).filter("size > 0")
    queue = packets.select("place", "epoch", "rank", "size", (F.col("end") / F.col("target")).alias("finish"))
    queue = number_rows(queue, [F.col("finish"), F.col("rank"), F.col("place"), F.col("epoch")], "turn")
    queue = running_totals(queue, [], ["turn"], {"spent": F.col("size")})
    budget = sized.agg(F.sum("size").alias("_budget"))
    room = F.col("_budget") - F.col("spent") + F.col("size")
    taken = queue.crossJoin(F.broadcast(budget)).filter(room > 0).groupBy("place")
    taken = taken.agg(F.sum(F.least(F.col("size"), room)).alias("taken"))
    out = placed.join(taken, "place", "left")
    return out.select(
        "doc_id", "source", *carry, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def first_words(text: str, n: int) -> str:
    """The text up to its n-th word."""
    found = next(islice(re.finditer(WORD, text), n - 1, n), None)
    return text[: found.end()] if found else text


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with the columns of `docs`: repeats are rows, an edge row is cut.

    Rows that are equal in `doc_id`, source and text are taken together.  `n_chars`, where there is
    one, follows the text.  Documents of no words are not taken.
    """

    @F.arrow_udf(returnType="string")
    def cut(texts: pa.Array, words: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), words.to_pylist(), strict=True)
        return pa.array([None if t is None else first_words(t, n) for t, n in pairs], pa.string())

    used = ["doc_id", "source", "text"]
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in used[:2]]
    key = F.struct(*names, *[F.col(c).isNull() for c in used[:2]], *[F.xxhash64(F.lit(i), "text") for i in (1, 2)])
    taken = mix(docs.select(*used, key.alias("_doc")), carry=["_doc"]).filter("taken > 0")
    taken = taken.groupBy("_doc").agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"))
    one = Window.partitionBy("_doc").orderBy(F.lit(0))
    rows = set_aside(docs, used).withColumn("_doc", key).join(taken, "_doc")
    rows = rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    copies = F.sequence(F.lit(0), F.ceil(F.col("_taken") / F.col("_size")) - 1)
    rows = rows.withColumn("_copy", F.explode(copies))
    left = F.least(F.col("_size"), F.col("_taken") - F.col("_copy") * F.col("_size"))
    part = cut(F.when(left < F.col("_size"), F.col("text")), left)
    out = rows.withColumn("text", F.coalesce(part, "text")).select(*bring_back(docs.columns, used))
    return with_length(out)


def with_length(docs: DataFrame) -> DataFrame:
    """`n_chars`, where there is one, after a change of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
