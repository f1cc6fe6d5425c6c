"""Columns that an operator only passes on, kept in one struct so that their names cannot clash with its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_aside(df: DataFrame, used: Sequence[str]) -> DataFrame:
    """The used columns and, where there are others, a struct `rest` of those."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return df.select(*used, *([F.struct(*others).alias("rest")] if others else []))


def bring_back(columns: Sequence[str], used: Sequence[str]) -> list[Column]:
    """The original columns, in their order."""
    return [F.col(c) if c in used else F.col("rest").getField(c).alias(c) for c in columns]
