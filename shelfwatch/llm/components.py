"""Connected components of a graph of links, over frames of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import spread_join
from ..session import cut_lineage

# Links that one task settles at once, 16 bytes each; more are settled in rounds over all tasks.
AT_ONCE = 1 << 19


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) with the same components as the links (a, b), one per node at most."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(lx, ly)[apart], np.minimum(lx, ly)[apart])
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _settled(links: DataFrame) -> DataFrame:
    """`components` of links `u, v` that one task can hold."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches if b.num_rows]
        if not found:
            return
        u, v = (np.concatenate(c) for c in zip(*found, strict=True))
        nodes, roots = spanning_links(u, v)
        least = np.unique(roots)
        ends = [pa.array(np.concatenate(c), pa.int64()) for c in ((nodes, least), (roots, least))]
        yield pa.RecordBatch.from_arrays(ends, ["node", "root"])

    return cut_lineage(links.coalesce(1).mapInArrow(settle, "node long, root long"))


def components(links: DataFrame, a: str = "a", b: str = "b", at_once: int = AT_ONCE) -> DataFrame:
    """`node, root` for every node that has a link to another: the smallest node reachable from it.

    At most `at_once` links are settled in one task.  For more, large-star and small-star steps
    alternate: each node hands its larger, then its smaller, neighbours to its smallest one.  Only
    minima are aggregated and every round is written to the shared folder; the number of rounds
    grows with the logarithm of the longest path.
    Links with a null end and links of a node to itself are dropped.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    links = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if links.count() <= at_once:
        return _settled(links)
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select("v", "v").distinct()
            )
        seen = state
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = spread_join(both.filter("v > u"), least, ["u"], "inner", ["v"], 4)
        large = cut_lineage(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, ["u"], "inner", ["v"], 4).filter("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
