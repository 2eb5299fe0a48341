"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import stored


def _nearest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``; a partial minimum comes before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    nearest = _nearest(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger ``u`` to the smaller ``v``."""
    nearest = _nearest(edges)
    moved = edges.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(nearest.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (``u``, ``v``, both bigint).

    The component is its smallest node. Each round attaches every node to the smallest it
    knows of; rounds are stored, and their number grows with the logarithm of the nodes. The joins
    are plain equi-joins whose large side a session with adaptive execution splits when one
    node has most of the edges.
    """
    now = stored(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    state = None
    while True:
        after = stored(_small_star(_large_star(now).distinct()).distinct(), "stars")
        new = after.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(new) == state:
            break
        now, state = after, tuple(new)
    own = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
