"""Roster lists and figures, for all rosters in one job.

The slot table is the large one. Figures are added up per (roster, unit nation) right after
the unit attributes are known and only then meet the roster, so a roster or a nation that
holds most of the slots is already a handful of rows when it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlab.functions import fixed_values as fv
from rosterlab.operators.catalog import Labels, category_names, known_units, nation_names

SLOT_NUMBERS = range(fv.FIRST_SLOT, fv.LAST_SLOT + 1)


def roster_list(
    rosters: DataFrame,
    nations: DataFrame,
    nation_id=None,
    roster_id=None,
    nation_labels: Labels = fv.NATION_LABELS,
) -> DataFrame:
    """Rosters with nation label, newest first; all of them unless a nation or an id is given."""
    wanted = rosters.where(F.col("nation_id") == F.lit(nation_id)) if nation_id else rosters
    if roster_id is not None:
        wanted = wanted.where(F.col("roster_id") == F.lit(roster_id))
    return (
        wanted.join(nation_names(nations, "nation", nation_labels), "nation_id")
        .select(*rosters.columns, "nation")
        .orderBy(F.col("created_at").desc_nulls_last(), F.col("roster_id").desc())
    )


def latest_roster_per_nation(rosters: DataFrame, nations: DataFrame | None = None) -> DataFrame:
    """The newest roster of each nation, of several the one with the highest id.

    With ``nations``, rosters of nations that do not exist are left out, as in every list. Times and
    ids are maxima of numbers, which are hashed; titles are fetched for the few that are left.
    """
    if nations is not None:
        rosters = rosters.join(nations.select("nation_id"), "nation_id", "left_semi")
    rows = rosters.select("nation_id", "roster_id", "title", "created_at")
    times = rows.groupBy("nation_id").agg(F.max("created_at").alias("_at"))
    newest = (
        rows.join(times.withColumnRenamed("nation_id", "_nation"), F.col("nation_id").eqNullSafe(F.col("_nation")))
        .where(F.col("created_at").eqNullSafe(F.col("_at")))
        .drop("_nation", "_at")
    )
    ids = newest.groupBy("nation_id").agg(F.max("roster_id").alias("roster_id"))
    last = ids.select(F.col("nation_id").alias("_nation"), F.col("roster_id").alias("_id"))
    same = F.col("nation_id").eqNullSafe(F.col("_nation")) & F.col("roster_id").eqNullSafe(F.col("_id"))
    return newest.join(last, same, "left_semi")


def roster_slots(slots: DataFrame) -> DataFrame:
    return slots.orderBy("roster_id", F.col("slot_no").asc_nulls_last(), "unit_id")


def roster_detail(
    rosters: DataFrame,
    nations: DataFrame,
    slots: DataFrame,
    units: DataFrame,
    categories: DataFrame,
    nation_labels: Labels = fv.NATION_LABELS,
    category_labels: Labels = fv.CATEGORY_LABELS,
    sort: bool = True,
) -> DataFrame:
    """Slots filled with a unit of the roster's own nation; other slots are left out."""
    shown = units.join(
        category_names(categories, "category", category_labels), "category_id"
    ).select(
        "unit_id", "nation_id", F.col("name").alias("unit_name"), "category", "tier", "rating",
        "cost",
    )
    owners = rosters.join(nation_names(nations, "nation", nation_labels), "nation_id").select(
        "roster_id", "nation_id", "title", "nation", "game_mode"
    )
    detail = (
        slots.join(shown, "unit_id")
        .join(owners, ["roster_id", "nation_id"])
        .select(
            "roster_id", "title", "nation", "game_mode", "slot_no", "unit_id", "unit_name",
            "category", "tier", "rating", "cost", "role_note",
        )
    )
    return detail.orderBy("roster_id", "slot_no", "unit_id") if sort else detail


def roster_summary(
    rosters: DataFrame,
    nations: DataFrame,
    slots: DataFrame,
    units: DataFrame,
    nation_labels: Labels = fv.NATION_LABELS,
) -> DataFrame:
    """Unit count, average and highest rating and total cost of every roster.

    Only units of the roster's nation count. A roster without any keeps its row: count 0,
    the other figures NULL.
    """
    figures = (
        slots.select("roster_id", "unit_id")
        .join(units.select("unit_id", "nation_id", "rating", "cost"), "unit_id")
        .groupBy("roster_id", "nation_id")
        .agg(
            F.count("unit_id").alias("unit_count"),
            F.round(F.avg("rating"), 1).alias("average_rating"),
            F.max("rating").alias("cap_same_nation"),
            F.sum("cost").cast("bigint").alias("total_cost"),
        )
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


def _or_dash(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(fv.NO_VALUE))


def roster_cap_list(summary: DataFrame) -> DataFrame:
    """Cap of every roster as text, with a dash where there is none."""
    return summary.select("roster_id", _or_dash("cap_same_nation").alias("cap_text"))


def roster_cards(summary: DataFrame) -> DataFrame:
    """The four figures of a roster as they are shown: dashes for no rating, 0 for no cost."""
    return summary.select(
        "roster_id",
        _or_dash("cap_same_nation").alias("cap_text"),
        _or_dash("average_rating").alias("average_text"),
        F.coalesce("total_cost", F.lit(0)).cast("bigint").alias("total_cost"),
        "unit_count",
    )


def roster_cap(slots: DataFrame, units: DataFrame) -> DataFrame:
    """Highest rating over all slots of a roster, whatever the unit's nation."""
    return (
        slots.select("roster_id", "unit_id")
        .where(F.col("roster_id").isNotNull())
        .join(units.select("unit_id", "rating"), "unit_id")
        .groupBy("roster_id")
        .agg(F.max("rating").alias("cap_all"))
    )


def category_counts(
    rosters: DataFrame,
    slots: DataFrame,
    units: DataFrame,
    categories: DataFrame,
    category_labels: Labels = fv.CATEGORY_LABELS,
    sort: bool = True,
) -> DataFrame:
    """Same-nation units per category label; a roster without any has no row."""
    labelled = units.join(
        category_names(categories, "category", category_labels), "category_id"
    ).select("unit_id", "nation_id", "category")
    counts = (
        slots.select("roster_id", "unit_id")
        .join(labelled, "unit_id")
        .groupBy("roster_id", "nation_id", "category")
        .agg(F.count(F.lit(1)).alias("unit_count"))
        .join(rosters.select("roster_id", "nation_id"), ["roster_id", "nation_id"], "left_semi")
        .select("roster_id", "category", "unit_count")
    )
    if not sort:
        return counts
    return counts.orderBy("roster_id", F.col("unit_count").desc(), "category")


def slot_grid(
    rosters: DataFrame,
    nations: DataFrame,
    slots: DataFrame,
    units: DataFrame,
    categories: DataFrame,
    category_labels: Labels = fv.CATEGORY_LABELS,
) -> DataFrame:
    """Ten rows for every roster, blank where no unit of its nation fills the slot.

    Each roster's slots become one row of ten ids by maxima of numbers, which are hashed; names and
    ratings join the filled cells after the grid is unfolded. Where a slot number occurs twice, the
    highest unit id is shown.
    """
    labelled = units.join(
        category_names(categories, "category", category_labels), "category_id"
    ).select("unit_id", "nation_id", F.col("name").alias("unit_name"), "category", "rating")
    filled = (
        slots.select("roster_id", "unit_id", "slot_no")
        .where(F.col("slot_no").between(fv.FIRST_SLOT, fv.LAST_SLOT))
        .join(labelled.select("unit_id", "nation_id"), "unit_id")
        .groupBy("roster_id", "nation_id")
        .agg(*[F.max(F.when(F.col("slot_no") == n, F.col("unit_id"))).alias(f"slot_{n}") for n in SLOT_NUMBERS])
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("slot_no"), F.col(f"slot_{n}").alias("unit_id")) for n in SLOT_NUMBERS]
    )
    # Blank cells match nothing; the second key keeps them from meeting in one task.
    spread = F.when(F.col("unit_id").isNull(), F.pmod(F.xxhash64("roster_id"), F.lit(1 << 16))).otherwise(0)
    cells = (
        rosters.select("roster_id", "nation_id")
        .join(nations.select("nation_id"), "nation_id", "left_semi")
        .join(filled, ["roster_id", "nation_id"], "left")
        .select("roster_id", F.explode(entries).alias("entry"))
        .select("roster_id", "entry.*")
        .withColumn("_spread", spread.cast("bigint"))
    )
    shown = labelled.drop("nation_id").withColumn("_spread", F.lit(0).cast("bigint"))
    return cells.join(shown, ["unit_id", "_spread"], "left").select(
        "roster_id", "slot_no", "unit_id", "unit_name", "category", "rating"
    )


def slot_occupancy(rosters: DataFrame, slots: DataFrame) -> DataFrame:
    """Whether each of a roster's ten slots is taken; one bit per slot until the last step."""
    inside = F.col("slot_no").between(fv.FIRST_SLOT, fv.LAST_SLOT)
    taken = (
        slots.where(inside)
        .groupBy("roster_id")
        .agg(F.bit_or(F.expr("shiftleft(1, slot_no)")).alias("bits"))
    )
    number = F.explode(F.sequence(F.lit(fv.FIRST_SLOT), F.lit(fv.LAST_SLOT)))
    return (
        rosters.select("roster_id")
        .join(taken, "roster_id", "left")
        .select("roster_id", F.coalesce("bits", F.lit(0)).alias("bits"), number.alias("slot_no"))
        .select("roster_id", "slot_no", F.expr("getbit(bits, slot_no) = 1").alias("is_taken"))
    )


def available_units(
    selected: DataFrame, listed_units: DataFrame, unit_nations: DataFrame, slots: DataFrame
) -> DataFrame:
    """Units of the nation of each *selected* roster that the roster does not hold yet.

    ``listed_units`` is a unit_search result. The answer lists a nation's catalogue once per
    selected roster; for figures over all rosters use ``available_counts``.
    """
    pool = listed_units.join(unit_nations.select("unit_id", "nation_id"), "unit_id")
    held = slots.select("roster_id", "unit_id")
    return (
        selected.select("roster_id", "nation_id")
        .join(pool, "nation_id")
        .join(held, ["roster_id", "unit_id"], "left_anti")
        .select("roster_id", "unit_id", "name", "category", "rating")
    )


def available_counts(
    rosters: DataFrame,
    units: DataFrame,
    nations: DataFrame,
    slots: DataFrame,
    categories: DataFrame,
) -> DataFrame:
    """How many units of its nation each roster could still add.

    Units of unknown nations or categories do not count, as no search lists them.
    """
    units = known_units(units, nations, categories)
    pool = units.groupBy("nation_id").agg(F.count(F.lit(1)).alias("nation_units"))
    held = (
        slots.select("roster_id", "unit_id")
        .join(units.select("unit_id", "nation_id"), "unit_id")
        .groupBy("roster_id", "nation_id", "unit_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("roster_id", "nation_id")
        .agg(F.count(F.lit(1)).alias("held_units"))
    )
    return (
        rosters.select("roster_id", "nation_id")
        .join(nations.select("nation_id"), "nation_id", "left_semi")
        .join(pool, "nation_id", "left")
        .join(held, ["roster_id", "nation_id"], "left")
        .select(
            "roster_id",
            (
                F.coalesce("nation_units", F.lit(0)) - F.coalesce("held_units", F.lit(0))
            ).cast("bigint").alias("available_count"),
        )
    )


def units_in_use(units: DataFrame, slots: DataFrame) -> DataFrame:
    """Units that sit in some slot."""
    return units.join(slots.select("unit_id").distinct(), "unit_id", "left_semi").select(
        "unit_id", "name"
    )


def stale_selection(selections: DataFrame, rosters: DataFrame) -> DataFrame:
    """Selections whose roster is not among the rosters of the selected nation."""
    return selections.join(
        rosters.select("roster_id", "nation_id"), ["roster_id", "nation_id"], "left_anti"
    ).select(*selections.columns)
