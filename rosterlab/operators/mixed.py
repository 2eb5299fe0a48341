"""Replay of an ordered log that mixes placements with removals.

``kind`` says what a change does: ``place`` a unit in a slot, ``remove_unit`` (the unit leaves the
roster, whatever slots hold it) or ``remove_slot`` (the slot is emptied). A removal of nothing
changes nothing. As in the replay of placements, only a *contended* unit, asked for or
stored in more than one slot of the roster, can make a placement fail, so only what places, clears
or drops such units is walked in order. What a slot holds at the end, and before each placement,
follows from the last placement of the slot, the emptyings of the slot and the removals of the
unit, which are windows per (roster, slot) and per (roster, unit).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlab.operators.changes import static_reason
from rosterlab.operators.replay import Replay, contended_pairs, place
from rosterlab.plans.durable import freeze

PLACE, REMOVE_UNIT, REMOVE_SLOT = "place", "remove_unit", "remove_slot"

_SLOT = ("roster_id", "unit_id", "slot_no", "role_note")
_CHANGE = ("change_id", "change_ts", "roster_id", "slot_no", "unit_id")
_LOG = ("change_id", "roster_id", "slot_no", "unit_id", "kind", "verdict")
_WALKED = (
    "change_id bigint, change_ts timestamp_ntz, roster_id bigint, slot_no int, unit_id bigint, "
    "taken boolean"
)
_UNIT, _NUMBER = ("roster_id", "unit_id"), ("roster_id", "slot_no")


def _at() -> Column:
    """Place of a change in the order; the other columns decide between rows that repeat an id."""
    return F.struct("change_ts", "change_id", "unit_id", "slot_no", "kind").alias("_at")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roster, held = None, {}
    for batch in batches:
        taken: list[bool | None] = []
        names = ("roster_id", "slot_no", "unit_id", "act")
        for this, slot_no, unit_id, act in zip(
            *[batch.column(n).to_pylist() for n in names], strict=True
        ):
            if this != roster:
                roster, held = this, {}
            outcome = None
            if act == "hold":
                held.setdefault(slot_no, set()).add(unit_id)
            elif act == "place":
                outcome = place(held, slot_no, unit_id)
            elif act == "clear":
                held.pop(slot_no, None)
            else:
                for units in held.values():
                    units.discard(unit_id)
            taken.append(outcome)
        flags = pa.array(taken, pa.bool_())
        walked = pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in _CHANGE], flags], names=[*_CHANGE, "taken"]
        )
        yield walked.filter(pc.is_valid(flags))


def _walk_input(base: DataFrame, events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contended units as stored, then what touches them; of clearings in a row the first."""
    start = base.join(pairs, list(_UNIT), "left_semi").select(*_NUMBER, "unit_id").distinct().select(
        F.lit(None).cast("bigint").alias("change_id"),
        F.lit(None).cast("timestamp_ntz").alias("change_ts"),
        "roster_id",
        F.col("slot_no").cast("int").alias("slot_no"),
        "unit_id",
        F.lit("").alias("kind"),
        F.lit("hold").alias("act"),
    )
    act = (
        F.when(F.col("contended"), F.when(F.col("kind") == PLACE, "place").otherwise("drop"))
        .when(F.col("kind") != REMOVE_UNIT, "clear")
    )
    before = F.lag("act").over(Window.partitionBy(*_NUMBER).orderBy("_at"))
    again = (F.col("act") == "clear") & F.coalesce(before == "clear", F.lit(False))
    moves = (
        events.join(pairs.select("roster_id").distinct(), "roster_id", "left_semi")
        .withColumn("act", act)
        .where("act IS NOT NULL")
        .withColumn("_again", again)
        .where("NOT _again")
        .select(*_CHANGE, "kind", "act")
    )
    return start.withColumn("step", F.lit(0)).unionByName(moves.withColumn("step", F.lit(1)))


def apply_mixed_changes(
    slots: DataFrame,
    changes: DataFrame,
    rosters: DataFrame,
    units: DataFrame,
    nations: DataFrame,
    categories: DataFrame,
) -> Replay:
    """Apply placements and removals in (change_ts, change_id) order, as if one after the other.

    The log has a row per change: a placement is ``add``, ``replace``, ``already_placed`` or the
    reason for which it is refused whatever the slots hold; a removal is ``remove``; another kind
    is ``kind_unknown``.
    """
    known = F.coalesce(F.col("kind").isin(PLACE, REMOVE_UNIT, REMOVE_SLOT), F.lit(False))
    judged = freeze(
        static_reason(changes, rosters, units, nations, categories).withColumn(
            "reason", F.when(~known, "kind_unknown").when(F.col("kind") == PLACE, F.col("reason"))
        )
    )
    valid = judged.where("reason IS NULL").select(
        F.col("change_id").cast("bigint").alias("change_id"),
        "change_ts",
        F.col("roster_id").cast("bigint").alias("roster_id"),
        F.when(F.col("kind") != REMOVE_UNIT, F.col("slot_no")).cast("int").alias("slot_no"),
        F.when(F.col("kind") != REMOVE_SLOT, F.col("unit_id")).cast("bigint").alias("unit_id"),
        "kind",
    )
    valid = valid.withColumn("_at", _at())
    base = slots.select(*_SLOT)
    pairs = freeze(contended_pairs(base, valid.where(F.col("kind") == PLACE)))
    events = valid.join(
        pairs.withColumn("contended", F.lit(True)), list(_UNIT), "left"
    ).withColumn("contended", F.coalesce("contended", F.lit(False)))
    walked = (
        _walk_input(base, events, pairs)
        .repartition("roster_id")
        .sortWithinPartitions(
            "roster_id", "step", "change_ts", "change_id", "unit_id", "slot_no", "kind"
        )
        .mapInArrow(_walk, _WALKED)
        .withColumn("kind", F.lit(PLACE))
        .withColumn("_at", _at())
    )
    free = events.where((F.col("kind") == PLACE) & ~F.col("contended"))
    placed = freeze(
        free.select(*_CHANGE, "kind", "_at", F.lit(True).alias("taken")).unionByName(walked)
    )
    by_unit = valid.where(F.col("kind") == REMOVE_UNIT)
    by_slot = valid.where(F.col("kind") == REMOVE_SLOT)

    # When each placed unit leaves by a removal of the unit.
    later = Window.partitionBy(*_UNIT).orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    leaves = F.min(F.when(F.col("kind") == REMOVE_UNIT, F.col("_at"))).over(later)
    columns = [*_CHANGE, "kind", "_at", "taken"]
    places = (
        placed.unionByName(by_unit.withColumn("taken", F.lit(False)).select(*columns))
        .withColumn("_leaves", leaves)
        .where(F.col("kind") == PLACE)
    )
    # The slot before each placement: the last placement or emptying, else what was stored.
    emptied = by_slot.withColumn("taken", F.lit(False)).select(*columns)
    before = Window.partitionBy(*_NUMBER).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("taken") | (F.col("kind") == REMOVE_SLOT)
    timeline = places.unionByName(emptied, allowMissingColumns=True).withColumn(
        "_before", F.last(F.when(counts, F.struct("kind", "_leaves")), ignorenulls=True).over(before)
    )
    gone = by_unit.groupBy(*_UNIT).agg(F.min("_at").alias("_gone"))
    stored = (
        base.join(gone, list(_UNIT), "left")
        .groupBy(*_NUMBER)
        .agg(F.bool_or(F.col("_gone").isNull()).alias("_stays"), F.max("_gone").alias("_until"))
    )
    unmoved = F.col("_stays") | (F.col("_until") > F.col("_at"))
    still = (F.col("_before.kind") == PLACE) & (
        F.col("_before._leaves").isNull() | (F.col("_before._leaves") > F.col("_at"))
    )
    verdict = (
        F.when(~F.col("taken"), "already_placed")
        .when(F.when(F.col("_before").isNull(), unmoved).otherwise(still), "replace")
        .otherwise("add")
    )
    outcomes = (
        timeline.where(F.col("kind") == PLACE)
        .join(stored, list(_NUMBER), "left")
        .withColumn("verdict", verdict)
    )

    last = (
        places.where("taken")
        .unionByName(emptied, allowMissingColumns=True)
        .groupBy(*_NUMBER)
        .agg(F.max_by(F.struct("kind", "unit_id", "_leaves"), "_at").alias("_last"))
    )
    filled = last.where((F.col("_last.kind") == PLACE) & F.col("_last._leaves").isNull()).select(
        "roster_id", F.col("_last.unit_id").alias("unit_id"), "slot_no", F.lit("").alias("role_note")
    )
    kept = base.join(last.select(*_NUMBER), list(_NUMBER), "left_anti").join(
        gone.select(*_UNIT), list(_UNIT), "left_anti"
    )
    others = judged.where((F.col("kind") != PLACE) | F.col("reason").isNotNull()).withColumn(
        "verdict", F.coalesce("reason", F.lit("remove"))
    )
    return Replay(
        kept.select(*_SLOT).unionByName(filled),
        others.select(*_LOG).unionByName(outcomes.select(*_LOG)),
    )
