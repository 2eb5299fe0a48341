"""Figures of rosters kept up to date from moves of units in and out.

A roster's figures follow from its tally: how many units of each nation, category and rating it
holds, and what they cost. A tally can be taken back: a unit that leaves counts -1. Ratings are added up
as decimals (ten digits behind the point), so the average does not depend on the order of moves; where the
exact average ends on a five, it can differ in its last digit from one of doubles. So the figures
are a log of signed tallies: version 0 for the slots at the start, then one version per batch of
moves, which costs its moves and nothing else. Counts and costs are sums over the versions; the
highest rating is that of the ratings whose count is not zero. ``compact`` folds the versions
into one.

Versions are folders below ``target``; writing one again replaces it, so a batch that is run again
changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.functions import fixed_values as fv
from rosterlab.operators.catalog import Labels, category_names, nation_names

_KEY = ("roster_id", "nation_id", "category_id", "rating")
_SUMS = ("units", "priced", "cost")
_COUNTS = "units <> 0 OR priced <> 0 OR cost <> 0"


def tally(moves: DataFrame, units: DataFrame) -> DataFrame:
    """Signed tallies of ``moves`` (roster_id, unit_id, weight); moves of unknown units count nothing."""
    known = units.select("unit_id", "nation_id", "category_id", "rating", "cost")
    return (
        moves.select("roster_id", "unit_id", "weight")
        .join(known, "unit_id")
        .groupBy(*_KEY)
        .agg(
            F.sum("weight").alias("units"),
            F.coalesce(F.sum(F.when(F.col("cost").isNotNull(), F.col("weight"))), F.lit(0)).alias("priced"),
            F.coalesce(F.sum(F.col("weight") * F.col("cost")), F.lit(0)).alias("cost"),
        )
        .where(_COUNTS)
        .select(F.col("roster_id").cast("bigint").alias("roster_id"), *_KEY[1:], *[F.col(c).cast("bigint") for c in _SUMS])
    )


@dataclass(frozen=True)
class FigureLog:
    """Tallies below ``target``; units do not change while a log is in use."""

    target: str
    units: DataFrame

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.target.rstrip('/')}/version={version}")

    def start(self, slots: DataFrame) -> None:
        """Version 0: all slots as they are."""
        self.add(slots.where("unit_id IS NOT NULL").select("roster_id", "unit_id", F.lit(1).alias("weight")), 0)

    def add(self, moves: DataFrame, version: int) -> None:
        """Units that came (weight 1) and left (-1), as one version."""
        self._write(tally(moves, self.units), version)

    def tallies(self) -> DataFrame:
        """The present tallies of all rosters. A filter on the roster reaches the files."""
        kinds = dict(self.units.dtypes)
        columns = ["roster_id bigint", *[f"{c} {kinds[c]}" for c in _KEY[1:]], *[f"{c} bigint" for c in _SUMS]]
        stored = self.units.sparkSession.read.schema(", ".join(columns)).parquet(self.target)
        sums = [F.sum(c).alias(c) for c in _SUMS]
        # Figures are of a roster's own nation: dealt by both, they are added up and meet the rosters without another shuffle.
        return stored.repartition("roster_id", "nation_id").groupBy(*_KEY).agg(*sums).where(_COUNTS)

    def compact(self, into: FigureLog) -> None:
        into._write(self.tallies(), 0)

    def summary(
        self, rosters: DataFrame, nations: DataFrame, nation_labels: Labels = fv.NATION_LABELS
    ) -> DataFrame:
        """The rows of ``roster_summary``."""
        rated = F.col("rating").isNotNull() & ~F.isnan("rating")
        total = F.sum(F.when(rated, F.col("rating").cast("decimal(24,10)") * F.col("units").cast("decimal(12,0)")))
        figures = (
            self.tallies()
            .groupBy("roster_id", "nation_id")
            .agg(
                F.sum("units").alias("unit_count"),
                (total.cast("double") / F.sum(F.when(rated, F.col("units")))).alias("_average"),
                F.max(F.when(F.col("units") > 0, F.col("rating"))).alias("cap_same_nation"),
                F.when(F.sum("priced") > 0, F.sum("cost")).cast("bigint").alias("total_cost"),
            )
            .withColumn("average_rating", F.round("_average", 1))
        )
        return (
            rosters.select("roster_id", "nation_id", "title")
            .join(nation_names(nations, "nation", nation_labels), "nation_id")
            .join(figures, ["roster_id", "nation_id"], "left")
            .select(
                "roster_id", "title", "nation",
                F.coalesce("unit_count", F.lit(0)).cast("bigint").alias("unit_count"),
                "average_rating", "cap_same_nation", "total_cost",
            )
        )

    def category_counts(
        self, rosters: DataFrame, categories: DataFrame, category_labels: Labels = fv.CATEGORY_LABELS
    ) -> DataFrame:
        """The rows of ``category_counts``."""
        return (
            self.tallies()
            .join(rosters.select("roster_id", "nation_id"), ["roster_id", "nation_id"], "left_semi")
            .join(category_names(categories, "category", category_labels), "category_id")
            .groupBy("roster_id", "nation_id", "category")
            .agg(F.sum("units").alias("unit_count"))
            .where("unit_count > 0")
            .select("roster_id", "category", "unit_count")
        )
