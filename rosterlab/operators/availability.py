"""What every roster could still add, as differences of bitmaps instead of pairs.

The units of a nation are one set that all its rosters share: a bitmap for each 32 768 ids. A roster's
answer is that set less the few units that it holds, so it is a nation, a short list and a count, however
many units the nation has. ``unfolded`` writes the units out, for rosters that are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.operators.catalog import known_units

_BITS = 1 << 15  # of one bitmap


def nation_bitmaps(units: DataFrame, nations: DataFrame, categories: DataFrame) -> DataFrame:
    """(nation_id, bucket, bits, units): which units each nation lists; partial bitmaps are merged."""
    listed = known_units(units, nations, categories).where("unit_id IS NOT NULL").select("nation_id", "unit_id")
    bucket = F.bitmap_bucket_number("unit_id").alias("bucket")
    return (
        listed.groupBy("nation_id", bucket)
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("unit_id")).alias("bits"))
        .withColumn("units", F.bitmap_count("bits"))
    )


def available_sets(
    rosters: DataFrame, units: DataFrame, nations: DataFrame, slots: DataFrame, categories: DataFrame
) -> DataFrame:
    """(roster_id, nation_id, held, available_count): the nation's units less ``held``, for every roster.

    Units of unknown nations or categories are neither listed nor held.
    """
    listed = known_units(units, nations, categories).select("unit_id", "nation_id")
    totals = (
        nation_bitmaps(units, nations, categories).groupBy("nation_id").agg(F.sum("units").alias("_all"))
    )
    held = (
        slots.select("roster_id", "unit_id")
        .join(listed, "unit_id")
        .groupBy("roster_id", "nation_id")
        .agg(F.sort_array(F.collect_set("unit_id")).alias("held"))
    )
    none = F.array().cast("array<bigint>")
    return (
        rosters.select("roster_id", "nation_id")
        .join(nations.select("nation_id"), "nation_id", "left_semi")
        .join(totals, "nation_id", "left")
        .join(held, ["roster_id", "nation_id"], "left")
        .withColumn("held", F.coalesce(F.col("held").cast("array<bigint>"), none))
        .select(
            "roster_id",
            "nation_id",
            "held",
            (F.coalesce("_all", F.lit(0)) - F.size("held")).cast("bigint").alias("available_count"),
        )
    )


def unfolded(sets: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(roster_id, unit_id) of some rosters' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("roster_id", "bucket", "bits", "held")), strict=True)
            for roster_id, bucket, bits, held in rows:
                place = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                # Ids above zero are filed from 1 on, others backwards from 0.
                ids = (bucket - 1) * _BITS + 1 + place if bucket > 0 else bucket * _BITS - place
                left = np.setdiff1d(ids, np.array(held, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(left), roster_id, np.int64)), pa.array(left.astype(np.int64))],
                    names=["roster_id", "unit_id"],
                )

    joined = sets.select(F.col("roster_id").cast("bigint").alias("roster_id"), "nation_id", "held").join(
        bitmaps, "nation_id"
    )
    return joined.select("roster_id", "bucket", "bits", "held").mapInArrow(run, "roster_id bigint, unit_id bigint")
