"""Bulk changes as snapshot transforms: tables and requests in, new tables and rejects out.

Stored tables are never modified. Each request row is taken or refused as a whole, and a refused
one comes back with its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlab.functions import expressions as ex
from rosterlab.functions import fixed_values as fv
from rosterlab.operators.catalog import known_units
from rosterlab.plans.durable import freeze
from rosterlab.plans.numbering import highest, number_rows


@dataclass(frozen=True)
class Registration:
    """Accepted wide rows (with new ids) and rejected request ids with reasons."""

    accepted: DataFrame
    rejected: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return split_staged(self.accepted)


def split_staged(staged: DataFrame) -> dict[str, DataFrame]:
    """Wide rows with ids → rows of unit, spec and munition (representative)."""
    return {
        "unit": staged.select(
            "unit_id", "nation_id", "category_id", "name", "tier", "rating", "cost", "media_path"
        ),
        "spec": staged.select("unit_id", "front", "side", "rear"),
        "munition": staged.select(
            "munition_id",
            "unit_id",
            F.col("munition_name").alias("name"),
            F.col("munition_kind").alias("kind"),
            "pen",
            F.lit(True).alias("is_representative"),
        ),
    }


def split_seed(staged: DataFrame, order_by: str) -> dict[str, DataFrame]:
    """First load of wide rows that bring their unit ids; munitions are numbered in input order."""
    return split_staged(number_rows(staged, [order_by], "munition_id"))


def flagged(keys: DataFrame, flag: str) -> DataFrame:
    return keys.withColumn(flag, F.lit(True))


def assign_ids(df: DataFrame, order_by: str, target: DataFrame, id_column: str) -> DataFrame:
    """Give the rows of ``df`` the ids after the highest one in ``target``, in input order."""
    top = highest(target, id_column)
    return number_rows(df, [order_by], id_column).withColumn(
        id_column, F.col(id_column) + F.lit(top)
    )


def staged_faults(
    unit: Column | None = None, spec: Column | None = None, munition: Column | None = None
) -> tuple[tuple[Column, str], ...]:
    """Range and reference faults of a wide row, in the order in which they are named.

    The conditions say whose values are used; by default all are. The row has flags ``_nation`` and
    ``_category``, NULL where the referenced row does not exist.
    """
    unit, spec, munition = (F.lit(True) if c is None else c for c in (unit, spec, munition))
    return (
        (unit & ~F.col("tier").between(fv.LOWEST_TIER, fv.HIGHEST_TIER), "tier_range"),
        (unit & (F.col("rating") < fv.LOWEST_RATING), "rating_low"),
        (unit & (F.col("cost") < 0), "cost_negative"),
        (
            spec & ((F.col("front") < 0) | (F.col("side") < 0) | (F.col("rear") < 0)),
            "armor_negative",
        ),
        (munition & (F.col("pen") < 0), "pen_negative"),
        (unit & F.col("_nation").isNull(), "nation_missing"),
        (unit & F.col("_category").isNull(), "category_missing"),
    )


def register_verdicts(
    batch: DataFrame, units: DataFrame, nations: DataFrame, categories: DataFrame
) -> DataFrame:
    """The batch with defaults filled in and ``reason`` (NULL = accepted).

    Order of the checks: required fields, name in use in the nation (any case), ranges,
    references. Inside the batch the first valid row of a name wins, in ``request_id`` order.
    """
    required = (
        "nation_id", "category_id", "tier", "rating", "front", "side", "rear", "munition_name",
        "pen",
    )
    missing: Column = F.lit(False)
    for column in required:
        missing = missing | F.col(column).isNull()
    own_fault = ex.first_reason(*staged_faults())
    staged = (
        batch.withColumns(
            {
                "name": ex.strip(F.col("name")),
                "cost": F.coalesce("cost", F.lit(0)),
                "media_path": F.coalesce("media_path", F.lit("")),
                "munition_kind": F.coalesce("munition_kind", F.lit("")),
            }
        )
        .join(flagged(nations.select("nation_id"), "_nation"), "nation_id", "left")
        .join(flagged(categories.select("category_id"), "_category"), "category_id", "left")
        .withColumns(
            {
                "_key": F.lower("name"),
                "_unfilled": ex.first_reason(
                    (ex.is_blank(F.col("name")), "name_missing"), (missing, "value_missing")
                ),
                "_fault": own_fault,
            }
        )
    )
    # One row per name: is it stored already, and which valid request of the batch was first.
    stored = units.select(
        "nation_id", F.lower("name").alias("_key"), F.lit(True).alias("_stored"),
        F.lit(None).cast("bigint").alias("_valid"),
    )
    valid = F.when(F.col("_unfilled").isNull() & F.col("_fault").isNull(), F.col("request_id"))
    asked = staged.where(F.col("_unfilled").isNull()).select(
        "nation_id", "_key", F.lit(False).alias("_stored"), valid.cast("bigint").alias("_valid")
    )
    names = (
        stored.unionByName(asked)
        .groupBy("nation_id", "_key")
        .agg(F.max("_stored").alias("_stored"), F.min("_valid").alias("_first"))
    )
    reason = F.coalesce(
        F.col("_unfilled"),
        F.when(F.col("_stored"), "name_taken"),
        F.when(F.col("request_id") > F.col("_first"), "name_taken_in_batch"),
        F.col("_fault"),
    )
    return staged.join(names, ["nation_id", "_key"], "left").select(
        *batch.columns, reason.alias("reason")
    )


def register_units(
    batch: DataFrame,
    units: DataFrame,
    munitions: DataFrame,
    nations: DataFrame,
    categories: DataFrame,
    tops: tuple[int, int] | None = None,
) -> Registration:
    """Register a batch of wide unit rows (``request_id`` and the staged columns).

    ``tops`` are the highest unit and munition id, if they are known.
    """
    # Stored, since numbering reads the accepted rows twice and the others are read once more.
    judged = freeze(register_verdicts(batch, units, nations, categories))
    accepted = judged.where(F.col("reason").isNull()).drop("reason")
    unit_top, shot_top = tops or (highest(units, "unit_id"), highest(munitions, "munition_id"))
    numbered = number_rows(accepted, ["request_id"], "_n").withColumns(
        {"unit_id": F.col("_n") + unit_top, "munition_id": F.col("_n") + shot_top}
    )
    return Registration(
        numbered.drop("_n"),
        judged.where(F.col("reason").isNotNull()).select(
            "request_id", "nation_id", "name", "reason"
        ),
    )


@dataclass(frozen=True)
class Deletion:
    unit: DataFrame
    spec: DataFrame
    munition: DataFrame
    rejected: DataFrame


def delete_units(
    requests: DataFrame,
    units: DataFrame,
    specs: DataFrame,
    munitions: DataFrame,
    slots: DataFrame,
) -> Deletion:
    """Delete units with their specs and munitions; a unit in any slot is refused.

    An unknown id changes nothing and is not refused.
    """
    asked = requests.select("unit_id").distinct()
    used = slots.select("unit_id").distinct()
    gone = asked.join(used, "unit_id", "left_anti")
    return Deletion(
        *[table.join(gone, "unit_id", "left_anti").select(*table.columns)
          for table in (units, specs, munitions)],
        rejected=asked.join(used, "unit_id", "left_semi").withColumn("reason", F.lit("in_use")),
    )


@dataclass(frozen=True)
class Creation:
    created: DataFrame
    rejected: DataFrame


def roster_verdicts(
    batch: DataFrame, nations: DataFrame, game_modes=fv.GAME_MODES
) -> DataFrame:
    reason = ex.first_reason(
        (ex.is_blank(F.col("title")), "title_blank"),
        (F.col("_nation").isNull(), "nation_missing"),
        (F.col("game_mode").isNull() | ~F.col("game_mode").isin(*game_modes), "mode_unknown"),
        (
            F.col("target_rating").isNull() | (F.col("target_rating") < fv.LOWEST_RATING),
            "target_low",
        ),
    )
    return (
        batch.withColumns(
            {
                "title": ex.strip(F.col("title")),
                "target_rating": F.col("target_rating").cast("double"),
            }
        )
        .join(flagged(nations.select("nation_id"), "_nation"), "nation_id", "left")
        .select(*batch.columns, reason.alias("reason"))
    )


def create_rosters(
    batch: DataFrame,
    rosters: DataFrame,
    nations: DataFrame,
    created_at: Column | None = None,
    game_modes=fv.GAME_MODES,
) -> Creation:
    """New rosters in ``request_id`` order, ids after the highest in use.

    ``created_at`` defaults to the current time; pass a literal for repeatable runs.
    """
    moment = F.localtimestamp() if created_at is None else created_at
    judged = roster_verdicts(batch, nations, game_modes)
    accepted = judged.where(F.col("reason").isNull())
    return Creation(
        assign_ids(accepted, "request_id", rosters, "roster_id").select(
            "roster_id", "nation_id", "title", "game_mode", "target_rating",
            moment.alias("created_at"),
        ),
        judged.where(F.col("reason").isNotNull()).select("request_id", "reason"),
    )


def static_reason(
    changes: DataFrame,
    rosters: DataFrame,
    units: DataFrame,
    nations: DataFrame,
    categories: DataFrame,
) -> DataFrame:
    """Changes with ``reason`` for the checks that do not look at other slots.

    In this order: roster, unit, same nation, slot number. The unit side comes first in the
    plan because it is the smaller table.
    """
    owners = rosters.join(nations.select("nation_id"), "nation_id", "left_semi").select(
        "roster_id", F.col("nation_id").alias("_roster_nation")
    )
    owned = known_units(units, nations, categories).select(
        "unit_id", F.col("nation_id").alias("_unit_nation")
    )
    reason = ex.first_reason(
        (F.col("_roster_nation").isNull(), "roster_missing"),
        (F.col("_unit_nation").isNull(), "unit_missing"),
        (F.col("_roster_nation") != F.col("_unit_nation"), "nation_mismatch"),
        (
            F.col("slot_no").isNull()
            | ~F.col("slot_no").between(fv.FIRST_SLOT, fv.LAST_SLOT),
            "slot_range",
        ),
    )
    return (
        changes.join(owned, "unit_id", "left")
        .join(owners, "roster_id", "left")
        .select(*changes.columns, reason.alias("reason"))
    )


def slot_change_verdicts(
    changes: DataFrame,
    slots: DataFrame,
    rosters: DataFrame,
    units: DataFrame,
    nations: DataFrame,
    categories: DataFrame,
) -> DataFrame:
    """What each change would do to this snapshot if it were the only one.

    ``add``, ``replace``, or the reason it is refused. ``already_placed``: the unit sits in
    another slot of the roster and not in this one. Slots are matched per (roster, slot) and per
    (roster, unit), both finer than a roster; the slots of a unit are one bit each.
    """
    judged = static_reason(changes, rosters, units, nations, categories)
    held = slots.select("roster_id", "slot_no").distinct().withColumn("_held", F.lit(True))
    numbered = F.col("slot_no").between(fv.FIRST_SLOT, fv.LAST_SLOT)
    bit = F.when(numbered, F.expr("shiftleft(1, CAST(slot_no AS INT))")).otherwise(0)
    placed = slots.groupBy("roster_id", "unit_id").agg(F.bit_or(bit).alias("_places"))
    here = F.expr("shiftright(_places, slot_no) & 1") == 1
    verdict = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("_places").isNotNull() & ~here, "already_placed")
        .when(F.col("_held"), "replace")
        .otherwise("add")
    )
    return (
        judged.join(held, ["roster_id", "slot_no"], "left")
        .join(placed, ["roster_id", "unit_id"], "left")
        .select("change_id", "roster_id", "slot_no", "unit_id", verdict.alias("verdict"))
    )


def remove_slots(
    slots: DataFrame, removals: DataFrame, by: tuple[str, str] = ("roster_id", "unit_id")
) -> DataFrame:
    """Slots without the removed ones, matched by (roster, unit) or (roster, slot number).

    A removal that matches nothing changes nothing.
    """
    keys = list(by)
    return slots.join(removals.select(*keys).distinct(), keys, "left_anti").select(*slots.columns)
