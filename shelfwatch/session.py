"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 1 << 14


def build_session(app: str = "shelfwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Skewed joins are split at run time even when that costs one more
    exchange, since one site may own a large share of all rows.  Joins whose
    partitions turn out small are hashed instead of sorted.  Streaming state is kept
    outside the heap and only its changes are written per batch.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    In local mode without one a temporary folder serves, since all tasks run on this machine;
    elsewhere a folder that executors do not share would lose rows, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def spread_rows(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """A written frame dealt to tasks of about `rows` rows: well-packed files are so small that few tasks read them all."""
    return df.repartition(df.count() // rows + 1)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from the written table.

    It survives the loss of executors, is columnar, and its size is known to the
    planner, which a checkpointed RDD's is not.  Hexadecimal ids and names take about half with zstandard.
    """
    path = shared_path(df.sparkSession, "step")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
