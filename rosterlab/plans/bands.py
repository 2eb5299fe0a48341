"""Totals over a closed band around many centres, without joining centres with rows.

Such a join grows with the product of both. Here rows are first added up per distinct value, and
the values and the edges of all bands are sorted together along the value axis. A band's total is the
running total up to its upper edge less the one before its lower edge. Running totals come from a tree
of two levels: the axis is cut into leaves at sampled quantiles, so each holds about as many points
however the values are spread; a leaf's rows are added up in order, and the totals of whole leaves, one
row each, are added up before them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlab.plans.durable import freeze, freeze_counted

LEAF_POINTS = 1 << 18
# A result of so many rows, some 100 bytes each, is sent to every task that joins it.
SMALL_RESULT = 1 << 18

_AT, _SIDE, _LEAF = "_at", "_side", "_leaf"
_BELOW, _ROW, _ABOVE = 0, 1, 2


def band_points(
    rows: DataFrame,
    value: str,
    totals: Mapping[str, Column],
    centres: DataFrame,
    centre: str,
    half_width: float,
    leaf_points: int = LEAF_POINTS,
) -> tuple[DataFrame, int]:
    """The distinct values with their totals, the edges of all bands, the leaf of each, and how many."""
    names = list(totals)
    low, high = F.col(centre) - half_width, F.col(centre) + half_width
    distinct = centres.select(centre).where(F.col(centre).isNotNull()).distinct()
    per_value = (
        rows.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(F.col(value).alias(_AT))
        .agg(*[agg.cast("bigint").alias(name) for name, agg in totals.items()])
        .select(F.lit(None).cast("double").alias(centre), _AT, F.lit(_ROW).alias(_SIDE), *names)
    )
    # Edges sort before (lower) or after (upper) the rows of the same value: the band is closed.
    nothing = [F.lit(0).cast("bigint").alias(name) for name in names]
    edges = distinct.select(
        centre,
        F.explode(
            F.array(
                F.struct(low.alias(_AT), F.lit(_BELOW).alias(_SIDE)),
                F.struct(high.alias(_AT), F.lit(_ABOVE).alias(_SIDE)),
            )
        ).alias("edge"),
    ).select(centre, f"edge.{_AT}", f"edge.{_SIDE}", *nothing)
    points, n = freeze_counted(per_value.unionByName(edges))
    leaves = max(1, -(-n // leaf_points))
    if leaves == 1:
        return points.withColumn(_LEAF, F.lit(0)), n
    # A repeated task might cut the axis elsewhere, so the leaves are stored.
    return freeze(points.repartitionByRange(leaves, _AT, _SIDE).withColumn(_LEAF, F.spark_partition_id())), n


def band_totals(
    rows: DataFrame,
    value: str,
    totals: Mapping[str, Column],
    centres: DataFrame,
    centre: str,
    half_width: float,
    leaf_points: int = LEAF_POINTS,
) -> DataFrame:
    """One row per distinct centre: ``centre`` and each total over value ∈ [centre ± half_width].

    ``totals`` maps output names to whole-number aggregates that add up (counts, integer
    sums), which keeps the difference of two running totals exact.
    """
    names = list(totals)
    points, n = band_points(rows, value, totals, centres, centre, half_width, leaf_points)
    # Two points a centre: the result's number of rows is known.
    few = n <= 2 * SMALL_RESULT
    in_leaf = Window.partitionBy(_LEAF).orderBy(_AT, _SIDE).rowsBetween(Window.unboundedPreceding, 0)
    running = points.select(
        centre, _LEAF, _SIDE, *[F.sum(name).over(in_leaf).alias(name) for name in names]
    ).where(F.col(_SIDE) != _ROW)
    if n > leaf_points:
        per_leaf = points.groupBy(_LEAF).agg(*[F.sum(name).alias(name) for name in names])
        earlier = Window.orderBy(_LEAF).rowsBetween(Window.unboundedPreceding, -1)
        before = per_leaf.select(
            _LEAF, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}{_LEAF}") for name in names]
        )
        running = running.join(F.broadcast(before), _LEAF).select(  # a row per leaf
            centre, _SIDE, *[(F.col(name) + F.col(f"{name}{_LEAF}")).alias(name) for name in names]
        )
    sign = F.when(F.col(_SIDE) == _ABOVE, 1).otherwise(-1)
    found = running.groupBy(centre).agg(*[F.sum(sign * F.col(name)).alias(name) for name in names])
    return F.broadcast(found) if few else found
