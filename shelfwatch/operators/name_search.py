"""Substring search over stored names by a trigram index.

The index is three Parquet tables below one folder: the catalog rows, dealt to places by their id and
numbered there, the postings dealt to parts by their trigram (three bytes of a lower-cased name), as lists of the rows
of a place that hold it, and the number of rows of each trigram.  A search looks up the trigrams that a match must hold,
reads the lists of the rarest, then only the places of the rows found there, and decides every row by the pattern itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 64
RAREST = 4
BLOCK_BYTES = 1 << 22
KEY = (T.StructField("_key", T.IntegerType()), T.StructField("_place", T.IntegerType()))
LISTS = "gram int, _place int, n long, keys binary"
POSTINGS = f"{LISTS}, _part int"


def literal_pieces(pattern: str) -> list[str]:
    """The runs of literal characters between the wildcards of a LIKE pattern."""
    pieces, i = [""], 0
    while i < len(pattern):
        escaped = pattern[i] == "\\" and i + 1 < len(pattern)
        i += escaped
        if pattern[i] in "%_" and not escaped:
            pieces.append("")
        else:
            pieces[-1] += pattern[i]
        i += 1
    return pieces


def trigrams(text: str) -> set[int]:
    """Three bytes of UTF-8 in a row as one number each."""
    b = text.encode()
    return {b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)}


def inverter(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that turns rows `(name, _place, _key)`, names of three bytes or more, in blocks of about `block_bytes`
    into the lists of `n` keys by trigram and place, each as the steps from key to key.  It carries its parts along, so workers need not import this package."""

    def inverted(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        name, place, key = (pa.concat_arrays([b.column(i) for b in rows]) for i in range(3))
        names = name.cast(pa.large_binary())
        ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
        text = np.frombuffer(names.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.int64)
        row = np.repeat(np.arange(len(names)), np.diff(ends))
        inside = row[:-2] == row[2:]
        gram = (text[:-2] << 16 | text[1:-1] << 8 | text[2:])[inside]
        held = np.sort(gram << 32 | row[:-2][inside])
        held = held[np.append(True, held[1:] != held[:-1])]
        gram, row = held >> 32, held & 0xFFFFFFFF
        places = place.to_numpy()[row]
        starts = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (places[1:] != places[:-1])))
        keys = key.to_numpy()[row]
        steps = np.diff(keys, prepend=keys[:1])
        steps[starts] = keys[starts]
        ends = np.append(starts, len(row))
        offsets = pa.py_buffer((ends * 4).astype(np.int32))
        lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(steps)])
        columns = [pa.array(gram[starts], pa.int32()), pa.array(places[starts], pa.int32()), pa.array(np.diff(ends)), lists]
        return pa.RecordBatch.from_arrays(columns, ["gram", "_place", "n", "keys"])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            step = max(1, batch.num_rows * block_bytes // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                rows.append(batch.slice(start, step))
                size += rows[-1].nbytes
                if size >= block_bytes:
                    yield inverted(rows)
                    rows, size = [], 0
        if rows:
            yield inverted(rows)

    return postings


def lister() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that turns rows `(_place, keys)` of `inverter` into a row `(_place, _key)` per key."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, steps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.cumsum(np.frombuffer(steps.as_buffer(), np.int32), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), place, np.int32)), pa.array(keys)], ["_place", "_key"])

    return listed


def write_name_index(games: DataFrame, path: str, parts: int = PARTS) -> None:
    """Stores the rows of `games(id, name, ...)` with their index; an older one at `path` is replaced.

    A trigram or id that holds many rows is written by several tasks.  Null and short
    names have no trigrams, and equal or null ids are no hindrance.
    """
    games.limit(0).write.mode("overwrite").parquet(f"{path}/schema")  # an empty catalog has no rows to read it from
    # Every task writes one place and numbers its rows from 0; postings are made of the rows as they are stored.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int")
    placed = games.hint("rebalance", "id").withColumns({"_key": number, "_place": F.spark_partition_id()})
    placed.write.mode("overwrite").partitionBy("_place").parquet(f"{path}/rows")
    name = F.lower("name")
    long_ = _rows(games.sparkSession, path).filter(F.octet_length(name) >= 3)
    lists = long_.select(name.alias("name"), "_place", "_key").mapInArrow(inverter(BLOCK_BYTES), LISTS)
    dealt = lists.withColumn("_part", F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int")).hint("rebalance", "_part")
    stored = dealt.sortWithinPartitions("_part", "gram").write.mode("overwrite").partitionBy("_part")
    stored.option("compression", "zstd").parquet(f"{path}/postings")
    postings = games.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
    counts = postings.groupBy("gram", "_part").agg(F.sum("n").alias("n"))
    counts.orderBy("gram").write.mode("overwrite").parquet(f"{path}/counts")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(T.StructType([*columns, *KEY])).parquet(f"{path}/rows")


def search_names(spark: SparkSession, path: str, search: str) -> DataFrame:
    """The stored rows whose name matches `%search%` in any case; `search` may hold `%`, `_` and escapes.

    Equal to a scan with ILIKE.  A pattern without three literal characters in a row has no trigram
    and is answered by that scan.
    """
    stored = _rows(spark, path)
    columns = [c for c in stored.columns if c not in ("_key", "_place")]
    pattern = f"%{search}%"
    matches = F.col("name").ilike(pattern)
    # Lower-cased by Spark and as a whole, as ILIKE does.
    lowered = spark.sql("SELECT lower(:pattern)", args={"pattern": pattern}).first()[0]
    needed = set().union(*map(trigrams, literal_pieces(lowered)))
    if not needed:
        return stored.filter(matches).select(*columns)
    # At most one row per trigram of the pattern comes back.
    known = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(*needed)).collect()
    if len(known) < len(needed):
        return stored.filter(F.lit(False)).select(*columns)
    rare = sorted(known, key=lambda r: (r["n"], r["gram"]))[:RAREST]
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(
        F.col("_part").isin(*{r["_part"] for r in rare}) & F.col("gram").isin(*[r["gram"] for r in rare])
    )
    # A row stands once in the lists of a trigram.
    listed = postings.select("_place", "keys").mapInArrow(lister(), "_place int, _key int")
    held = listed.groupBy("_place", "_key").count()
    # At most one number per place comes back; only places that hold a row are opened.
    places = [r["_place"] for r in held.filter(F.col("count") == len(rare)).select("_place").distinct().collect()]
    opened = stored.filter(F.col("_place").isin(*places)) if places else stored.filter(F.lit(False))
    return opened.filter(matches).select(*columns)
