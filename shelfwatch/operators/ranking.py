"""Order inside a key without holding a whole key in one task.

A plain window sorts all rows of a key in one task.  Here a key is first cut
into spans of its integer order column; ranks inside a span and totals of the
spans before it add up to the same result, and one span holds at most `span`
consecutive order values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

SPAN = 65536
SCAN_SPAN = 4096


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], span: int = SPAN
) -> DataFrame:
    """Adds for each name the sum of its value over the rows of the key up to and including this one.

    `order[0]` is an integer column; the others break ties.  Most keys fit one span:
    only spans with something before them are joined with their offset.
    """
    keys = list(keys)
    cut = df.select("*", F.floor(F.col(order[0]) / span).alias("_span"), *[v.alias(f"_{n}") for n, v in values.items()])
    inside = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy(*keys, "_span").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values])
    offsets = spans.select(*keys, "_span", *[F.sum(f"_{n}").over(before).alias(f"_o_{n}") for n in values])
    offsets = offsets.filter(F.coalesce(*[f"_o_{n}" for n in values]).isNotNull())
    ranked = cut.select(
        *df.columns, "_span", *[F.sum(f"_{n}").over(inside).alias(f"_i_{n}") for n in values]
    ).join(offsets, [*keys, "_span"], "left")
    return ranked.select(
        *df.columns, *[(F.col(f"_i_{n}") + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in values]
    )


def running_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n", span: int = SPAN
) -> DataFrame:
    """Row number inside a key, from 1."""
    return running_totals(df, keys, order, {name: F.lit(1)}, span)


def scan_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], span: int = SCAN_SPAN
) -> DataFrame:
    """`running_totals` for any order columns and any share of the largest key: a segmented scan.

    All rows are range-sorted by key and order and numbered; a key is summed in pieces of at most `span`
    consecutive rows, and the totals of the pieces before it are carried over.  No group of rows is
    larger than `span`, whatever the values of the order columns.
    """
    placed = number_rows(df, [F.col(c) for c in (*keys, *order)], "_place")
    return running_totals(placed, keys, ["_place"], values, span).drop("_place")


def scan_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n", span: int = SCAN_SPAN
) -> DataFrame:
    """Row number inside a key, from 1, by `scan_totals`."""
    return scan_totals(df, keys, order, {name: F.lit(1)}, span)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str) -> DataFrame:
    """The first `n` rows of every key with their number.

    Spark cuts each task's rows to `n` per key before the exchange
    (WindowGroupLimit), so a large key costs no more than a small one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in `order` (W03), by an aggregate with map-side combine."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    lead = [c for c in order if c not in keys]
    first = F.min(F.struct(*lead, *rest)).alias("_f")
    return df.groupBy(*keys).agg(first).select(*keys, "_f.*").select(*df.columns)


def _sorted_ranges(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The sorted rows with `_id` and the range `_task` they lie in, and each range's first place and size.

    A range sort and one number per task: only the row counts of the tasks are
    summed in one place.  The sorted rows are written, so a task that runs
    again cannot number its rows differently.
    """
    tag = F.monotonically_increasing_id()
    cut = df.orderBy(*order).withColumn("_id", tag)
    cut = cut_lineage(cut.withColumn("_task", F.shiftright("_id", 33)))
    counts = cut.groupBy("_task").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return cut, counts.select("_task", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def _with_place(cut: DataFrame, starts: DataFrame, name: str) -> DataFrame:
    row = F.col("_id") - F.shiftleft(F.col("_task"), 33)
    return cut.join(F.broadcast(starts), "_task").withColumn(name, F.col("_start") + row)


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Dense global number from 0 in the given order."""
    cut, starts = _sorted_ranges(df, order)
    return _with_place(cut, starts.select("_task", "_start"), name).select(*df.columns, name)


def rows_between(df: DataFrame, order: Sequence[Column], first: int, n: int) -> DataFrame:
    """The `n` rows from place `first` (from 0) on in the given order, however deep.

    Whole ranges before and behind the page are skipped by their counts, and of the written rows only
    the ranges of the page are read; no task gets more than its share of these.
    """
    cut, starts = _sorted_ranges(df, order)
    here = starts.filter((F.col("_start") < first + n) & (F.col("_start") + F.col("_n") > first))
    low, high = here.agg(F.min("_task"), F.max("_task")).first()
    if low is None:
        return df.limit(0)
    pages = cut.filter(F.col("_task").between(low, high))
    placed = _with_place(pages, here.select("_task", "_start"), "_place")
    return placed.filter(F.col("_place").between(first, first + n - 1)).select(*df.columns)


def sorted_number(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Row number inside a key, from 1, with one exchange of the rows.

    A range sort deals the rows; each task counts them off as they pass, and only a task's first key can
    have begun in the tasks before it.  What these hold of that key is added from one row per task: of an
    earlier task it is the last key.  Null keys are numbered together.
    """
    schema = T.StructType([*df.schema, T.StructField(name, T.LongType(), False), T.StructField("_task", T.IntegerType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(key).dictionary_encode("encode").indices.to_numpy()
            starts = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
            at = np.arange(batch.num_rows)
            number = at - np.repeat(starts, np.diff(np.append(starts, batch.num_rows))) + 1
            if last is not None and batch.column(key)[0].as_py() == last[0]:
                head = starts[1] if len(starts) > 1 else batch.num_rows
                number[:head] += seen
            last, seen = (batch.column(key)[-1].as_py(),), int(number[-1])
            columns = [*batch.columns, pa.array(number, pa.int64()), pa.array(np.full(batch.num_rows, task), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, name, "_task"])

    placed = cut_lineage(df.orderBy(key, *order).mapInArrow(count, schema))
    held = placed.groupBy("_task").agg(
        F.min_by(F.struct(F.col(key).alias("k")), F.struct(key, name)).alias("first"),
        F.max(F.struct(F.col(key).alias("k"), F.col(name).alias("n"))).alias("last"),
    )
    held = cut_lineage(held.select("_task", F.col("first.k").alias("first"), F.col("last.k").alias("last"), F.col("last.n").alias("n")))
    earlier = held.select(F.col("_task").alias("_before"), F.col("last").alias("_last"), F.col("n").alias("_held"))
    carried = held.join(earlier, (F.col("_before") < F.col("_task")) & F.col("_last").eqNullSafe(F.col("first")))
    carried = carried.groupBy("_task", F.col("first").alias("_first")).agg(F.sum("_held").alias("_held"))
    joined = placed.join(F.broadcast(carried), "_task", "left")
    own = F.when(F.col(key).eqNullSafe(F.col("_first")), F.coalesce("_held", F.lit(0))).otherwise(0)
    return joined.select(*df.columns, (F.col(name) + own).alias(name))


def spread_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str, spread_by: Sequence[str], parts: int = 16
) -> DataFrame:
    """Join on `keys` where one key may own a large share of `big`.

    The rows of a key in `big` are spread over `parts` tasks by a hash of
    `spread_by`; `small` (at most one row per key) is repeated `parts` times.
    For joins that keep or drop rows of `big`: inner, left, left_semi, left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
