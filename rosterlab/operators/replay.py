"""Exact replay of ordered slot changes.

Whether a change is taken depends on the changes before it in the same roster, but only where a
unit is asked for, or stored, in more than one slot of that roster: only such a *contended* change
can find its unit elsewhere. Every other change just overwrites its slot. Contended changes are
walked in order in Python; a free change meets them only as "this slot holds no contended unit any
more", which the first one after a contended change of the slot says for all that follow. The rest,
the outcome of every change and the final slots, are windows and aggregates per (roster, slot).

Contended units tie the slots that they meet together; slots that no unit ties are independent of each
other. So the walk goes by such groups of slots, and the changes of one roster, however many, are walked
in as many tasks as it has groups. One group stays sequential by meaning; its task streams and holds the
contended units of its slots alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rosterlab.operators.changes import static_reason
from rosterlab.plans.durable import freeze

_SLOT = ("roster_id", "unit_id", "slot_no", "role_note")
_CHANGE = ("change_id", "change_ts", "roster_id", "slot_no", "unit_id")
_LOG = ("change_id", "roster_id", "slot_no", "unit_id", "verdict")
_WALKED = (
    "change_id bigint, change_ts timestamp_ntz, roster_id bigint, slot_no int, unit_id bigint, "
    "taken boolean"
)
# Note of a slot that was placed by a change.
_NEW_NOTE = ""


def _in_slot() -> WindowSpec:
    """Changes of one slot in their order; the unit decides between rows that repeat an id."""
    return Window.partitionBy("roster_id", "slot_no").orderBy("change_ts", "change_id", "unit_id")


def place(held: dict[int, set[int]], slot_no: int, unit_id: int) -> bool:
    """Apply one contended change to a roster's contended units by slot; False if refused."""
    here = held.get(slot_no, ())
    if unit_id not in here and any(unit_id in units for units in held.values()):
        return False
    held[slot_no] = {unit_id}
    return True


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, held = None, {}
    names = ("roster_id", "slots", "step", "slot_no", "unit_id", "contended")
    for batch in batches:
        taken: list[bool | None] = []
        for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            roster_id, slots, step, slot_no, unit_id, contended = row
            if (roster_id, slots) != group:
                group, held = (roster_id, slots), {}
            outcome = None
            if step == 0:
                held.setdefault(slot_no, set()).add(unit_id)
            elif contended:
                outcome = place(held, slot_no, unit_id)
            else:
                held.pop(slot_no, None)
            taken.append(outcome)
        flags = pa.array(taken, pa.bool_())
        walked = pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in _CHANGE], flags], names=[*_CHANGE, "taken"]
        )
        yield walked.filter(pc.is_valid(flags))


def slot_bit(slot_no: Column) -> Column:
    """A bit for a slot number; slots without a number share one, as do numbers 62 apart."""
    place = F.pmod(F.coalesce(slot_no, F.lit(-1)), F.lit(62)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def contended_masks(slots: DataFrame, movable: DataFrame) -> DataFrame:
    """Contended (roster, unit) pairs with the bits of all slots that the unit meets."""
    asked = movable.groupBy("roster_id", "unit_id").agg(
        F.min("slot_no").alias("_low"), F.max("slot_no").alias("_high"),
        F.bit_or(slot_bit(F.col("slot_no"))).alias("_asked"),
    )
    # A stored slot without a number is a place of its own.
    number = F.coalesce(F.col("slot_no"), F.lit(-1))
    stored = slots.groupBy("roster_id", "unit_id").agg(
        F.min(number).alias("_stored_low"), F.max(number).alias("_stored_high"),
        F.bit_or(slot_bit(F.col("slot_no"))).alias("_held"),
    )
    return (
        asked.join(stored, ["roster_id", "unit_id"], "left")
        .where(F.least("_low", "_stored_low") < F.greatest("_high", "_stored_high"))
        .select("roster_id", "unit_id", F.col("_asked").bitwiseOR(F.coalesce("_held", F.lit(0))).alias("_mask"))
    )


def contended_pairs(slots: DataFrame, movable: DataFrame) -> DataFrame:
    """(roster, unit) pairs that a change asks for and that meet more than one slot number."""
    return contended_masks(slots, movable).drop("_mask")


def slot_groups(masks: DataFrame) -> DataFrame:
    """(roster, groups): the slots of each roster that contended units tie together, as disjoint bit sets."""
    def joined(groups: Column, mask: Column) -> Column:
        meets = lambda g: g.bitwiseAND(mask) != 0
        apart = F.filter(groups, lambda g: ~meets(g))
        tied = F.aggregate(F.filter(groups, meets), mask, lambda a, g: a.bitwiseOR(g))
        return F.concat(apart, F.array(tied))

    none = F.array().cast("array<bigint>")
    return masks.groupBy("roster_id").agg(
        F.aggregate(F.collect_set("_mask"), none, joined).alias("_groups")
    )


def walk_input(slots: DataFrame, flagged: DataFrame, masks: DataFrame) -> DataFrame:
    """What the walk has to see, by group of slots: where contended units are, then (step 1) changes."""
    groups = slot_groups(masks)

    def grouped(rows: DataFrame) -> DataFrame:
        of_slot = F.filter("_groups", lambda g: g.bitwiseAND(slot_bit(F.col("slot_no"))) != 0)
        return (
            rows.join(groups, "roster_id")
            .withColumn("slots", F.get(of_slot, F.lit(0)))
            .where("slots IS NOT NULL")
            .drop("_groups")
        )

    start = slots.join(masks, ["roster_id", "unit_id"], "left_semi").select(
        "roster_id", "slot_no", "unit_id"
    ).distinct().select(
        F.lit(None).cast("bigint").alias("change_id"),
        F.lit(None).cast("timestamp_ntz").alias("change_ts"),
        "roster_id",
        F.col("slot_no").cast("int").alias("slot_no"),
        "unit_id",
        F.lit(False).alias("contended"),
        F.lit(0).alias("step"),
    )
    follows_free = F.lag(~F.col("contended")).over(_in_slot())
    moves = (
        grouped(flagged.select(*_CHANGE, "contended"))
        .withColumn("_seen", F.coalesce(follows_free, F.lit(False)) & ~F.col("contended"))
        .where("NOT _seen")
        .select(*_CHANGE, "contended", "slots", F.lit(1).alias("step"))
    )
    return grouped(start).select(*moves.columns).unionByName(moves)


@dataclass(frozen=True)
class Replay:
    """Slots after all changes, and the outcome of every change."""

    slots: DataFrame
    log: DataFrame


def apply_slot_changes(
    slots: DataFrame,
    changes: DataFrame,
    rosters: DataFrame,
    units: DataFrame,
    nations: DataFrame,
    categories: DataFrame,
    store: bool = False,
) -> Replay:
    """Apply changes in (change_ts, change_id) order, as if one after the other.

    Changes that are refused whatever the slots hold take no part. Slots that no change takes are
    passed through as they are. ``store`` keeps the outcomes in the shared folder, for callers
    that read both the slots and the log.
    """
    judged = freeze(static_reason(changes, rosters, units, nations, categories))
    refused = judged.where(F.col("reason").isNotNull()).withColumn("verdict", F.col("reason"))
    movable = judged.where(F.col("reason").isNull()).select(
        F.col("change_id").cast("bigint").alias("change_id"),
        "change_ts",
        F.col("roster_id").cast("bigint").alias("roster_id"),
        F.col("slot_no").cast("int").alias("slot_no"),
        F.col("unit_id").cast("bigint").alias("unit_id"),
    )
    base = slots.select(*_SLOT)
    masks = freeze(contended_masks(base, movable))
    pairs = masks.drop("_mask")
    flagged = movable.join(
        pairs.withColumn("contended", F.lit(True)), ["roster_id", "unit_id"], "left"
    ).withColumn("contended", F.coalesce("contended", F.lit(False)))
    walked = (
        walk_input(base, flagged, masks)
        .repartition("roster_id", "slots")
        .sortWithinPartitions("roster_id", "slots", "step", "change_ts", "change_id", "unit_id", "slot_no")
        .mapInArrow(_walk, _WALKED)
    )
    free = flagged.where("NOT contended").select(*_CHANGE, F.lit(True).alias("taken"))
    decided = free.unionByName(walked)
    if store:
        decided = freeze(decided)

    last = (
        decided.where("taken")
        .groupBy("roster_id", "slot_no")
        .agg(F.max_by("unit_id", F.struct("change_ts", "change_id", "unit_id")).alias("unit_id"))
        .withColumn("role_note", F.lit(_NEW_NOTE))
    )
    kept = base.join(last.select("roster_id", "slot_no"), ["roster_id", "slot_no"], "left_anti")
    filled = base.select("roster_id", "slot_no").distinct().withColumn("_filled", F.lit(True))
    taken_so_far = F.sum(F.col("taken").cast("int")).over(
        _in_slot().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    verdict = (
        F.when(~F.col("taken"), "already_placed")
        .when(F.col("_filled") | (F.col("_nth") > 1), "replace")
        .otherwise("add")
    )
    outcomes = (
        decided.withColumn("_nth", taken_so_far)
        .join(filled, ["roster_id", "slot_no"], "left")
        .withColumn("verdict", verdict)
    )
    return Replay(
        kept.select(*_SLOT).unionByName(last.select(*_SLOT)),
        refused.select(*_LOG).unionByName(outcomes.select(*_LOG)),
    )
