"""A unit against its peers: the units rated within a band around the roster's cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.functions import expressions as ex
from rosterlab.functions import fixed_values as fv
from rosterlab.operators.roster import roster_cap
from rosterlab.plans.bands import band_totals
from rosterlab.plans.durable import freeze

_MEASURED = ("pen", "front", "side", "rear")


def peer_averages(
    units: DataFrame,
    specs: DataFrame,
    munitions: DataFrame,
    caps: DataFrame,
    cap: str = "cap_all",
    half_width: float = fv.BAND_HALF_WIDTH,
) -> DataFrame:
    """Per distinct cap: its band, the number of peers and their average pen, front, side, rear.

    Peers are all units with a spec and a representative munition; a unit with several
    representative munitions weighs once for each.
    """
    peers = (
        units.select("unit_id", "rating")
        .join(specs, "unit_id")
        .join(munitions.where("is_representative").select("unit_id", "pen"), "unit_id")
    )
    # Averages skip NULLs, so each metric brings the count of its own values along.
    totals = {"peer_count": F.count(F.lit(1))}
    for m in _MEASURED:
        totals[f"sum_{m}"] = F.coalesce(F.sum(m), F.lit(0))
        totals[f"n_{m}"] = F.count(m)
    added = band_totals(peers, "rating", totals, caps, cap, half_width)
    low, high = F.col(cap) - half_width, F.col(cap) + half_width
    return added.select(
        cap,
        low.alias("band_low"),
        high.alias("band_high"),
        F.format_string("%.1f ~ %.1f", low, high).alias("band_label"),
        "peer_count",
        *[
            F.when(F.col(f"n_{m}") > 0, F.col(f"sum_{m}") / F.col(f"n_{m}")).alias(f"avg_{m}")
            for m in _MEASURED
        ],
    )


def peer_benchmark(
    pairs: DataFrame,
    slots: DataFrame,
    units: DataFrame,
    specs: DataFrame,
    munitions: DataFrame,
    half_width: float = fv.BAND_HALF_WIDTH,
    one_munition: bool = False,
) -> DataFrame:
    """Values of the unit of each (roster, unit) pair next to the averages of its peers.

    The unit need not belong to the roster. A unit without spec or representative munition
    has no row; one with several representative munitions has a row for each, or only for the
    lowest munition id with ``one_munition``. A roster without any unit has no cap: count 0 and
    NULL averages.
    """
    # Stored, since both the bands and the rows of the result read them.
    caps = freeze(roster_cap(slots, units))
    # Stored for the same reason.
    shown = freeze(
        munitions.where("is_representative").select("unit_id", "munition_id", "name", "kind", "pen", "is_representative")
    )
    # A row per distinct cap: sent to all rosters while there are few enough, see ``band_totals``.
    averages = peer_averages(units, specs, shown, caps, half_width=half_width)
    shots = shown.select(
        "unit_id",
        "munition_id",
        F.col("name").alias("munition_name"),
        F.col("kind").alias("munition_kind"),
        "pen",
    )
    if one_munition:
        first = F.min(F.struct("munition_id", "munition_name", "munition_kind", "pen"))
        shots = shots.groupBy("unit_id").agg(first.alias("first")).select("unit_id", "first.*")
    cards = (
        units.select("unit_id", F.col("name").alias("unit_name"), "rating")
        .join(specs, "unit_id")
        .join(shots, "unit_id")
    )
    return (
        pairs.select("roster_id", "unit_id")
        .join(caps.join(averages, "cap_all", "left"), "roster_id", "left")
        .join(cards, "unit_id")
        .select(
            "roster_id",
            "unit_id",
            "cap_all",
            "band_low",
            "band_high",
            F.coalesce("band_label", F.lit(fv.NO_VALUE)).alias("band_label"),
            "unit_name",
            "rating",
            "munition_id",
            "munition_name",
            "munition_kind",
            *_MEASURED,
            F.coalesce("peer_count", F.lit(0)).cast("bigint").alias("peer_count"),
            *[f"avg_{m}" for m in _MEASURED],
        )
    )


def peer_benchmark_long(
    wide: DataFrame, metrics: Sequence[tuple[str, str, str, str]] = fv.METRICS
) -> DataFrame:
    """One row per compared metric, with the gap in percent and its verdict.

    ``wide`` is a ``peer_benchmark`` with one munition per unit. The verdict looks at the
    unrounded gap; an absent average counts as 0 and gives gap 0.
    """
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("metric"),
                    F.lit(family).alias("metric_family"),
                    F.col(m).cast("double").alias("selected"),
                    F.coalesce(f"avg_{m}", F.lit(0.0)).alias("average"),
                    F.lit(measure).alias("measure"),
                )
                for m, label, family, measure in metrics
            ]
        )
    )
    context = (
        "roster_id", "unit_id", "cap_all", "band_label", "peer_count", "unit_name", "rating",
        "munition_name", "munition_kind",
    )
    gap = ex.percent_gap(F.col("m.selected"), F.col("m.average"))
    return (
        wide.select(*context, rows.alias("m"))
        .withColumn("gap", gap)
        .select(
            "roster_id",
            "unit_id",
            "m.metric",
            "m.metric_family",
            "m.selected",
            F.round("m.average", 1).alias("average"),
            F.round("gap", 1).alias("gap_pct"),
            ex.verdict(F.col("gap")).alias("verdict"),
            "m.measure",
            "cap_all",
            "band_label",
            "peer_count",
            "unit_name",
            "rating",
            "munition_name",
            "munition_kind",
        )
    )


def metric_family(long: DataFrame, family: str) -> DataFrame:
    """The rows of one family of metrics (``penetration`` or ``armor``)."""
    return long.where(F.col("metric_family") == family)
