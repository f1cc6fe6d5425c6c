"""Which names of a batch are stored already, by Bloom filters in front of the stored names.

Names are dealt to partitions by hash.  A partition's filter is a sparse table of 64-bit words, filled
and probed by joins.  A batch opens the filters and the partitions in which some name may be
stored; these are compared exactly, so a full filter costs reading and never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PROBES = 7
# Rows of names or of their probes that one task sorts or groups, however many there are.
TASK_ROWS = 1 << 18
# A filter of at most so many words, some 20 MB, is sent to all tasks.
SENT_WORDS = 1 << 19
FILTER = "part int, word long, bits long, batch long"


@dataclass(frozen=True)
class Members:
    """A store of names below `root`, written batch by batch.

    `parts` and `words` (64-bit words of a partition's filter) are fixed for the life of a
    store; about 10 bits a name keep false hits below one in a hundred, so the default
    serves 27 million names.
    """

    root: str
    parts: int = 256
    words: int = 1 << 14

    def part(self, name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.parts)).cast("int")

    def probes(self, names: DataFrame, name: str) -> DataFrame:
        """`name, part, word, mask` of the bits of every name, and how many these are."""
        spots = F.transform(
            F.sequence(F.lit(1), F.lit(PROBES)),
            lambda i: F.pmod(F.xxhash64(name, F.lit("start"), i), F.lit(self.words * 64)),
        )
        found = names.select(name, self.part(name).alias("part"), F.array_distinct(spots).alias("spots"))
        spot = found.select(name, "part", F.size("spots").alias("wanted"), F.explode("spots").alias("spot"))
        mask = F.expr("shiftleft(1L, CAST(spot % 64 AS INT))")
        return spot.select(name, "part", F.floor(F.col("spot") / 64).alias("word"), mask.alias("mask"), "wanted")

    def _distinct(self, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The distinct names, and the number of tasks they were dealt to."""
        tasks = rows.count() // TASK_ROWS + 1
        return rows.select(name).filter(F.col(name).isNotNull()).repartition(tasks, name).distinct(), tasks

    def add(self, names: DataFrame, name: str, batch: int) -> None:
        """Stores the distinct names of a batch; a batch that is repeated replaces itself."""
        rows, _ = self._distinct(names, name)
        dealt = rows.withColumn("part", self.part(name)).hint("rebalance", "part")
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/names/batch={batch}")
        words = self.probes(rows, name).groupBy("part", "word").agg(F.bit_or("mask").alias("bits"))
        words.write.mode("overwrite").parquet(f"{self.root}/filter/batch={batch}")

    def maybe(self, names: DataFrame, name: str, before: int) -> DataFrame:
        """The distinct names all of whose bits some batch has set, with their partition."""
        rows, tasks = self._distinct(names, name)
        asked = self.probes(rows, name)
        try:
            filters = names.sparkSession.read.schema(FILTER).parquet(f"{self.root}/filter")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return asked.filter(F.lit(False)).select(name, "part")
            raise
        # One row per word, so a bit is met once; its size is bounded by the store's parts and words.
        filters = filters.filter(F.col("batch") < before).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
        small = self.parts * self.words <= SENT_WORDS
        if small:  # the probes stay with their names
            met = asked.join(F.broadcast(filters), ["part", "word"])
        else:
            met = asked.repartition(PROBES * tasks, "part", "word").join(filters, ["part", "word"])
        met = met.filter(F.col("mask").bitwiseAND(F.col("bits")) != 0).select(name, "part", "wanted")
        found = (met if small else met.repartition(PROBES * tasks, name)).groupBy(name, "part", "wanted").agg(F.count("*").alias("met"))
        return found.filter("met = wanted").select(name, "part")

    def unseen(self, rows: DataFrame, name: str, before: int) -> DataFrame:
        """The rows whose name no batch before `before` has stored; a null name is always unseen."""
        maybe = self.maybe(rows, name, before)
        # At most `parts` numbers come back.
        opened = [r["part"] for r in maybe.select("part").distinct().collect()]
        if not opened:
            return rows
        stored = rows.sparkSession.read.schema(f"`{name}` string, batch long, part int").parquet(f"{self.root}/names")
        stored = stored.filter((F.col("batch") < before) & F.col("part").isin(*opened))
        held, tasks = self._distinct(stored, name)
        tasks = max(tasks, rows.count() // TASK_ROWS + 1)
        dealt = rows.repartition(tasks, name)
        return dealt.join(held.repartition(tasks, name), name, "left_anti").select(*rows.columns)
