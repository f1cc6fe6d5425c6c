"""Continuous variants.

All sinks are idempotent: a batch that runs again after a failure writes the same
folder again, or the file sink's log keeps its rows once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import timestamp
from ..operators.guards import MIN_FIRST, SHRINK, check_status, is_success
from ..operators.ranking import first_per
from ..plans.full_run import commit_run, full_run, load_state
from ..session import cut_lineage
from ..sources import tables
from ..sources.documents import documents_of
from ..sources.members import Members

BATCH_ROWS = 1 << 16
CHECKED = ("run", "url_count", "baseline", "baseline_run")
FOLDED = "domain string, " + ", ".join(f"{c} array<long>" for c in CHECKED)


def landing_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed files as a stream of `(path, content)`, one file per row."""
    return spark.readStream.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def stream_diff(files: DataFrame, root: str, checkpoint: str, fetch_meta, as_of) -> StreamingQuery:
    """Each batch of landed `files(path, content)` is one run against the tables under `root`.

    `fetch_meta(spark)` gives the fetch records, `as_of(batch_id)` the time of a run.
    The manifest keeps the batch number, so a batch that was published is not run again.
    """
    spark = files.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= tables.last_batch(spark, root):
            return
        gen = tables.next_gen(spark, root)
        docs = documents_of(batch, fetch_meta(spark), missing=False)
        result = full_run(docs, load_state(spark, root), as_of(batch_id), gen)
        commit_run(spark, root, gen, result, batch_id)

    return (
        files.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def baseline_checks(counts: DataFrame, min_first: int = MIN_FIRST, shrink: float = SHRINK) -> DataFrame:
    """Every row of a stream `(domain, run, url_count)` with the state of its domain before it.

    The state store holds the last accepted count and run per domain; a batch reads and writes the
    states of the domains it has rows of.  Batches count in the order in which they arrive, the rows
    of a domain inside a batch in that of their runs, so a late run is judged by what was accepted before it
    came.  A batch's rows of a domain are folded in one task: limit the files of a batch if they are many.
    """

    def whole(values: pd.Series) -> list:
        if values.dtype.kind == "i":
            return values.tolist()
        return [None if v is None or v != v else int(v) for v in values.tolist()]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pairs = [p for f in frames for p in zip(whole(f["run"]), whole(f["url_count"]), strict=True)]
        pairs.sort(key=lambda p: [(v is None, v or 0) for v in p])
        count, run = state.get if state.exists else (None, None)
        before = []
        for r, c in pairs:
            before.append((count, run))
            if c is not None and c > 0 and (c >= min_first if count is None else c >= count * shrink):
                count, run = c, r
        if count is not None:
            state.update((count, run))
        runs, counts = zip(*pairs, strict=True)
        baseline, baseline_run = zip(*before, strict=True)
        columns = {"run": runs, "url_count": counts, "baseline": baseline, "baseline_run": baseline_run}
        # One row of lists: frames and Arrow columns cost more than the checks of most domains.
        yield pd.DataFrame({"domain": [key[0]]} | {name: [list(values)] for name, values in columns.items()})

    rows = counts.select("domain", F.col("run").cast("long"), F.col("url_count").cast("long"))
    folded = rows.groupBy("domain").applyInPandasWithState(
        fold, FOLDED, "url_count long, run long", "append", GroupStateTimeout.NoTimeout
    )
    folded = folded.select("domain", F.inline(F.arrays_zip(*CHECKED)))
    status = check_status(F.col("url_count"), F.col("baseline"), min_first, shrink)
    return folded.withColumn("status", status).withColumn("accepted", is_success(F.col("status")))


def stream_baseline(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes `baseline_checks` to `<out>/checks`, each row once."""
    return (
        baseline_checks(counts)
        .writeStream.format("parquet")
        .option("path", f"{out}/checks")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_first_seen(
    entities: DataFrame,
    out: str,
    checkpoint: str,
    order: tuple[str, ...] = ("feed_ord", "pos", "url"),
    members: Members | None = None,
) -> StreamingQuery:
    """Appends the first row, in `order`, of every clean name that no earlier batch had.

    The first row of a name in a batch is a minimum, combined before the exchange.  With `members`
    the stored names are behind filters, and a batch opens only the partitions of names it may
    hold already; without, all stored names are read.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        if members:
            # Dealt by name to tasks of about as many rows however large the batch is, and written once.
            dealt = batch.repartition(batch.count() // BATCH_ROWS + 1, "clean_name")
            rows = cut_lineage(first_per(dealt, ["clean_name"], list(order)))
            rows = cut_lineage(members.unseen(rows, "clean_name", batch_id))
            members.add(rows, "clean_name", batch_id)
        else:
            rows = first_per(batch, ["clean_name"], list(order))
        if not members and batch_id:
            stored = batch.sparkSession.read.parquet(out).filter(F.col("batch") < batch_id)
            rows = rows.join(stored.select("clean_name"), "clean_name", "left_anti").select(*batch.columns)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        entities.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_counts(events: DataFrame, at: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Rows per day."""
    stamped = events.select(timestamp(F.col(at)).cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    days = stamped.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return days.select(F.to_date("window.start").alias("date"), "n")


def stream_daily_counts(
    events: DataFrame, out: str, checkpoint: str, at: str = "ts", watermark: str = "1 day"
) -> StreamingQuery:
    """Each batch adds the new counts of the days it changes; `read_daily_counts` shows the last ones.

    A day that ended before the watermark is closed: rows that arrive for it later are dropped.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        daily_counts(events, at, watermark)
        .writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_daily_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("date").agg(F.max_by("n", "batch").alias("n"))
