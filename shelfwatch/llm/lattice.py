"""Near-duplicate vectors by hashing to the cells of the E8 lattice.

Every table projects a unit vector to 8 random orthogonal directions, scales it and decodes it
to the nearest point of E8.  A vector is entered in that cell and in the nearest of the 240
cells around it; two vectors meet where they share a cell of a table, and their cosine is
verified in double precision there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import spread_join
from ..session import cut_lineage
from .components import components, spanning_links
from .groups import group_starts, whole_groups

TABLES = 4
PROBES = 4
SCALE = 8.0
BLOCK = 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = minimal_vectors()


def nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: the worst coordinate is rounded the other way where the sum is odd."""
    z = np.rint(y)
    odd = np.flatnonzero(z.sum(axis=1) % 2)
    error = y[odd] - z[odd]
    worst = np.abs(error).argmax(axis=1)
    rows = np.arange(len(odd))
    z[odd, worst] += np.where(error[rows, worst] >= 0, 1.0, -1.0)
    return z


def nearest_point(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of the even integer points and the same shifted by 1/2."""
    whole, half = nearest_even(y), nearest_even(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def cell_codes(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Codes (row, table, 1 + probes) of the cells of unit vectors, home cell first.

    The scale is for 64 components; a projection of shorter vectors keeps more of their length.
    """
    pick = np.random.default_rng([seed, x.shape[1]])
    out = np.empty((len(x), tables, probes + 1), np.int64)
    for t in range(tables):
        directions = np.linalg.qr(pick.standard_normal((max(8, x.shape[1]), 8)))[0][: x.shape[1]]
        y = scale * np.sqrt(max(8, x.shape[1]) / 64) * x @ directions
        home = nearest_point(y)
        around = np.argpartition(-((y - home) @ ROOTS.T), probes, axis=1)[:, :probes]
        cells = np.concatenate([home[:, None], home[:, None] + ROOTS[around]], axis=1)
        out[:, t] = np.ascontiguousarray((2 * cells).astype(np.int8)).view(np.int64)[..., 0]
    return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of lists of one length as a matrix."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def by_length(table: pa.Table | pa.RecordBatch, column: str) -> Iterator[pa.Table | pa.RecordBatch]:
    """The rows of a table by the length of their lists."""
    lengths = pc.list_value_length(table[column])
    for length in pc.unique(lengths).to_pylist():
        yield table.filter(pc.equal(lengths, length))


def cosine_groups(
    vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 9
) -> DataFrame:
    """`vec_id, n_links, component_id, kept` of every row of `vec_id, embedding, label`.

    Two vectors are linked if their labels are equal, their lengths are equal and their cosine is
    at least `least`.  A vector that is null, empty, zero, or holds null or non-finite components,
    or whose label is null, has no links and is its own component.  Equal vectors are searched
    once and counted as often as they occur.  `component_id` is the smallest `vec_id` reachable; a
    null `vec_id` never names a component unless that has no other.  Crowded cells are split
    into blocks whose pairs are compared in separate tasks.  Other columns are not read.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.col("label").isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "label", x.alias("embedding"))
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    marks = [F.when(F.col("valid"), F.xxhash64(F.lit(i), F.size("embedding"), "embedding")).alias(f"h{i}") for i in (1, 2)]
    rows = cut_lineage(rows.select("*", *marks))
    key = ["label", "h1", "h2"]
    classes = rows.filter("valid").groupBy(*key).agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")
    )
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    kind = classes.withColumn("kind", F.xxhash64("label", F.size("embedding")))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "embedding"):
                x = matrix(part["embedding"])
                codes = cell_codes(x / np.linalg.norm(x, axis=1, keepdims=True), tables, probes, scale, seed)
                n, per = len(x), tables * (probes + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(part["id"].to_numpy(), per)),
                    pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes + 1), n)),
                    pa.array(codes.ravel()),
                ], ["id", "table", "cell"])

    entered = kind.select("id", "embedding").mapInArrow(enter, "id long, table int, cell long")
    cells = entered.join(kind.select("id", "kind"), "id")
    place = ["kind", "table", "cell"]
    crowds = cells.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1")
    met = cells.join(crowds, place)
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.select("id", *place, parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("own"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    met = met.join(classes.select("id", "copies", "embedding"), "id")

    met = met.repartition(*place, "low", "high").sortWithinPartitions(*place, "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (x for g in whole_groups(batches, [*place, "low", "high"]) for x in by_length(g, "embedding")):
            ids, copies = t["id"].to_numpy(), t["copies"].to_numpy()
            x = matrix(t["embedding"])
            a, b = _pairs(t, x, group_starts(t, [*place, "low", "high"]))
            nodes, roots = spanning_links(ids[a], ids[b])
            links = np.zeros(len(ids), np.int64)
            for at in range(0, len(a), 1 << 14):
                i, j = _here_first(t, x, a[at : at + (1 << 14)], b[at : at + (1 << 14)])
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids[some], nodes]), pa.int64()),
                pa.array([None] * len(some) + roots.tolist(), pa.int64()),
                pa.array(links[some].tolist() + [None] * len(nodes), pa.int64()),
            ], ["a", "b", "links"])

    def _pairs(t: pa.Table, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of one cell whose cosine is large enough: both of a block, or one of each of two blocks."""
        sizes = np.diff(np.append(starts, t.num_rows))
        group, small = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= 16, sizes)
        own, norms = t["own"].to_numpy(), np.linalg.norm(x, axis=1)
        within = t["low"].to_numpy() == t["high"].to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, 16):
            i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
            if not len(i):
                break
            j = i + step
            keep = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j]) >= least
            a.append(i[keep])
            b.append(j[keep])
        for start, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
            for at in range(start, start + size, BLOCK):
                some = slice(at, min(at + BLOCK, start + size))
                rest = slice(at, start + size)
                i, j = np.nonzero(x[some] @ x[rest].T / (norms[some][:, None] * norms[rest][None, :]) >= least)
                keep = i < j
                a.append(i[keep] + at)
                b.append(j[keep] + at)
        a, b = np.concatenate(a), np.concatenate(b)
        keep = within[a] | (own[a] != own[b])
        return a[keep], b[keep]

    def _here_first(t: pa.Table, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs for which this cell is the first of those they share, so that each is counted once."""
        rows, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        codes = cell_codes(x[rows] / np.linalg.norm(x[rows], axis=1, keepdims=True), tables, probes, scale, seed)
        i, j = ends[: len(a)], ends[len(a) :]
        table, cell = t["table"].to_numpy()[a], t["cell"].to_numpy()[a]
        met_before = np.zeros(len(a), bool)
        for other in range(tables):
            shared = (codes[i, other][:, :, None] == codes[j, other][:, None, :]).any(axis=2)
            earlier = (codes[i, other] < cell[:, None]) | (other < table)[:, None]
            met_before |= (other <= table) & (shared & earlier).any(axis=1)
        return a[~met_before], b[~met_before]

    found = cut_lineage(met.mapInArrow(compare, "a long, b long, links long"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null")).withColumnRenamed("node", "id")
    known = classes.select("id", *key, "least", "copies").join(counts, "id", "left").join(roots, "id", "left")
    known = known.withColumn("root", F.coalesce("root", "id"))
    names = known.groupBy("root").agg(F.min("least").alias("component"))
    known = spread_join(known, names, ["root"], "inner", ["id"], 4)
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    out = spread_join(rows.drop("embedding"), known.select(*key, "component", links), key, "left", ["vec_id"], 4)
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        F.col("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
