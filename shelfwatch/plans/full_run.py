"""A complete run over all feeds (T05) and the forced variant."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators import registry, reports
from ..operators.extract import extract_entities
from ..operators.maintenance import retain_logs
from ..operators.snapshots import DailyResult, daily_check, snapshot_check, with_new_counts
from ..session import cut_lineage, spread_rows
from ..sources import tables


class State(NamedTuple):
    """The tables a run reads."""

    snapshots: DataFrame
    snapshot_urls: DataFrame
    games: DataFrame
    sources: DataFrame
    logs: DataFrame
    log_items: DataFrame


class RunResult(NamedTuple):
    checks: DataFrame
    diff: DataFrame
    changes: DataFrame
    snapshots: DataFrame
    advanced_urls: DataFrame
    games: DataFrame
    sources: DataFrame
    logs: DataFrame
    log_items: DataFrame
    report: dict[str, DataFrame]
    added: dict[str, DataFrame]
    as_of: object
    keep_days: int


def load_state(spark: SparkSession, root: str) -> State:
    read = lambda name: tables.read_table(spark, root, name)
    return State(
        read("snapshots"),
        read("snapshot_urls"),
        read("games"),
        read("game_sources"),
        read("update_logs"),
        read("update_log_items"),
    )


def full_run(docs: DataFrame, state: State, as_of, gen: int = 0, keep_days: int = 30) -> RunResult:
    """Check all documents, register the entities behind new URLs, log and report.

    `docs` carries `feed_ord` from `feeds.feed_order`.  The candidates are
    checkpointed once: they are a small part of the URLs and many steps read them.
    The result has the next tables whole, and `added`, the rows by which they differ.
    """
    check = snapshot_check(docs, state.snapshots, state.snapshot_urls, as_of, gen)
    diff = cut_lineage(check.diff)
    up = registry.upsert_entities(cut_lineage(extract_entities(spread_rows(diff))), state.games, state.sources, as_of)
    changes = cut_lineage(up.changes)
    new_logs, new_items = registry.log_rows(changes, as_of), registry.log_items(changes, as_of)
    logs = state.logs.unionByName(new_logs)
    kept, _ = retain_logs(logs, as_of, keep_days)
    items = state.log_items.unionByName(new_items)
    kept_items = items.join(kept.select(kept["id"].alias("log_id")), "log_id", "left_semi").select(*items.columns)
    return RunResult(
        with_new_counts(check.checks, diff),
        diff,
        changes,
        check.snapshots,
        check.advanced_urls,
        up.games,
        up.sources,
        kept,
        kept_items,
        reports.run_report(check.checks, changes, logs, as_of, keep_days),
        {
            "games": up.changed_games,
            "game_sources": up.new_sources,
            "snapshot_urls": check.advanced_urls,
            "snapshots": check.advanced,
            "update_logs": new_logs,
            "update_log_items": new_items,
        },
        as_of,
        keep_days,
    )


def commit_run(spark: SparkSession, root: str, gen: int, result: RunResult, batch: int | None = None) -> None:
    """Adds what the run changed, registry first, then snapshots: a run that stops in between finds the same news again."""
    tables.commit(spark, root, gen, result.added, batch, False, result.as_of, result.keep_days)


def forced_run(docs: DataFrame, state: DataFrame, as_of) -> tuple[DailyResult, dict[str, DataFrame]]:
    """Fetch all feeds whatever the day, then the unified report under the manual error rule."""
    result = daily_check(docs, state, as_of, force=True)
    checks, diff = cut_lineage(result.checks), cut_lineage(result.diff)
    return result._replace(checks=checks, diff=diff), reports.unified_report(checks, diff, "manual")
