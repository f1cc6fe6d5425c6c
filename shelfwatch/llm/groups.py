"""Whole groups from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def group_starts(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Position of the first row of every run of equal keys."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = table[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold all rows of their keys, from batches sorted by integer keys.

    At most one batch and the rows of one key are held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = held and all(held[-1][k][-1].as_py() == batch[k][0].as_py() for k in keys)
        last = int(group_starts(batch, keys)[-1])
        if held and (last or not same):
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
