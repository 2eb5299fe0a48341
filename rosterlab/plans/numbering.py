"""Consecutive numbers over a total order, without a one-task window over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlab.plans.durable import freeze

_PART, _POS, _ROWS, _BEFORE = "_part", "_pos", "_rows", "_before"
# monotonically_increasing_id keeps the row's place within its partition in the low 33 bits.
_PLACE_BITS = 33


def highest(df: DataFrame, column: str) -> int:
    """Largest id in use, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("top")).first()["top"]


def number_rows(df: DataFrame, order_by: Sequence[Column | str], into: str) -> DataFrame:
    """Add ``into`` = 1, 2, 3, … in the given total order.

    The rows are range-sorted, and each row's partition and place in it are stored as data
    (a checkpoint), so a recomputed stage cannot renumber them. What then meets in one task
    and is broadcast is one row per partition.
    """
    placed = freeze(
        df.orderBy(*order_by).select(
            "*",
            F.spark_partition_id().alias(_PART),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias(_POS),
        )
    )
    sizes = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias(_ROWS))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum(_ROWS).over(earlier), F.lit(0)).alias(_BEFORE))
    return (
        placed.join(F.broadcast(offsets), _PART)
        .withColumn(into, F.col(_BEFORE) + F.col(_POS) + 1)
        .drop(_PART, _POS, _BEFORE)
    )
