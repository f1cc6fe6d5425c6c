"""Table versions on plain Parquet.

A run writes what it changes of a table to `<root>/<table>/version=<n>` and then appends one
manifest row per table.  Readers follow the manifest, so they see all tables of a run
or none, and a run that is repeated writes the same folders again.

A version is whole or an addition to those since the last whole one, so a run that changes k
entities writes k rows.  Of `games` and `snapshots` the last row of a key counts; the URLs of a
snapshot are those of the version its header names; log rows are dropped by the time of their
version, so retention opens no log file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.text import timestamp
from ..operators.quality import days_before
from ..operators.ranking import spread_join
from ..schemas import TABLES

MANIFEST = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("batch", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("keep_from", T.TimestampType()),
    ]
)
KEYS = {"games": ["id", "clean_name"], "snapshots": ["domain"]}
LOGS = ("update_logs", "update_log_items")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, known to the planner, which drops joins with them; rows from Python's side would start its workers."""
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).limit(0)


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty(spark, MANIFEST)
        raise


def _live(spark: SparkSession, root: str, name: str) -> list[int]:
    """The versions that make up a table: the last whole one and the additions since; one row per run comes back."""
    rows = _manifest(spark, root).filter(F.col("table") == name)
    whole = F.coalesce(F.max(F.when(F.col("whole"), F.col("version"))), F.lit(-1))
    start = rows.agg(whole.alias("start"), F.max("keep_from").alias("oldest"))
    rows = rows.crossJoin(F.broadcast(start)).filter("version >= start")
    if name in LOGS:
        rows = rows.filter("at is null or oldest is null or at >= oldest")
    return sorted({r["version"] for r in rows.select("version").collect()})


def last_batch(spark: SparkSession, root: str) -> int:
    """The last stream batch that was published, -1 before the first."""
    return _manifest(spark, root).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def next_gen(spark: SparkSession, root: str) -> int:
    return _manifest(spark, root).agg(F.coalesce(F.max("version") + 1, F.lit(0))).first()[0]


def commit(
    spark: SparkSession,
    root: str,
    gen: int,
    frames: dict[str, DataFrame],
    batch: int | None = None,
    whole: bool = True,
    as_of=None,
    keep_days: int | None = None,
) -> None:
    """Write the tables of a run in the given order, then publish them together.

    With `whole=False` the frames hold only what the run adds or changes at `as_of`; log
    versions from more than `keep_days` before are dropped from then on.
    """
    for name, df in frames.items():
        df.select(*TABLES[name].fieldNames()).write.mode("overwrite").parquet(f"{root}/{name}/version={gen}")
    at = F.lit(None).cast("timestamp") if as_of is None else timestamp(as_of)
    keep = F.lit(None).cast("timestamp") if keep_days is None else days_before(as_of, keep_days)
    rows = spark.createDataFrame([(name, gen, batch, whole) for name in frames], MANIFEST[:4])
    rows.select("*", at.alias("at"), keep.alias("keep_from")).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    live, schema = _live(spark, root, name), TABLES[name]
    if not live:
        return empty(spark, schema)
    stored = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
        .option("basePath", f"{root}/{name}")
        .parquet(*[f"{root}/{name}/version={v}" for v in live])
    )
    if name in KEYS:
        # Joins that keep or drop keys are pushed below this aggregate, so few rows are looked up without sorting all.
        rest = [c for c in schema.fieldNames() if c not in KEYS[name]]
        last = stored.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*rest), "version").alias("_last"))
        return last.select(*KEYS[name], "_last.*").select(*schema.fieldNames())
    if name == "snapshot_urls":
        headers = read_table(spark, root, "snapshots").select("domain", F.col("gen").alias("version"))
        stored = spread_join(stored, headers, ["domain", "version"], "left_semi", ["url"])
    if name == "update_logs":
        # A whole version may hold rows of any time.
        oldest = _manifest(spark, root).agg(F.max("keep_from")).first()[0]
        if oldest is not None:
            stored = stored.filter(F.col("checked_at").isNull() | (F.col("checked_at") >= F.lit(oldest)))
    if name == "update_log_items":
        logs = read_table(spark, root, "update_logs").select(F.col("id").alias("log_id"))
        stored = spread_join(stored, logs, ["log_id"], "left_semi", ["url"])
    return stored.select(*schema.fieldNames())


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty versions of all tables; existing ones are replaced."""
    commit(spark, root, next_gen(spark, root), {n: empty(spark, s) for n, s in TABLES.items()})


def reset_tables(spark: SparkSession, root: str, keep: tuple[str, ...] = ("feeds",)) -> None:
    frames = {n: empty(spark, s) for n, s in TABLES.items() if n not in keep}
    commit(spark, root, next_gen(spark, root), frames)


def compact_snapshot_urls(spark: SparkSession, root: str) -> None:
    """Rewrite the live snapshot URLs into one version, after which older ones may be removed."""
    gen = next_gen(spark, root)
    headers = read_table(spark, root, "snapshots").withColumn("gen", F.lit(gen).cast("bigint"))
    commit(spark, root, gen, {"snapshot_urls": read_table(spark, root, "snapshot_urls"), "snapshots": headers})


def describe_columns(df: DataFrame, table: str) -> DataFrame:
    """Name, type and order of the columns of a table, as rows."""
    fields = [(table, i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        fields, "table_name string, ordinal int, column_name string, data_type string, is_nullable boolean"
    )


def table_exists(spark: SparkSession, root: str, name: str) -> bool:
    return bool(_live(spark, root, name))
