import random
from datetime import datetime, timedelta

import pytest

from rosterlab.operators.changes import slot_change_verdicts
from rosterlab.operators.replay import apply_slot_changes, contended_masks, slot_groups, walk_input
from tests.conftest import rows

START = datetime(2024, 1, 1)
CHANGE = "change_id long, change_ts timestamp_ntz, roster_id long, slot_no int, unit_id long"


def one_by_one(slots, changes, rosters, units):
    """The same changes in plain Python, one after the other."""
    held = {(r, s): (u, note) for r, u, s, note in slots}
    log = {}
    for change_id, _, roster, slot, unit in sorted(changes, key=lambda c: (c[1], c[0])):
        if roster not in rosters:
            log[change_id] = "roster_missing"
        elif unit not in units:
            log[change_id] = "unit_missing"
        elif rosters[roster] != units[unit]:
            log[change_id] = "nation_mismatch"
        elif not 1 <= slot <= 10:
            log[change_id] = "slot_range"
        else:
            now = held.get((roster, slot), (None, None))[0]
            if now != unit and any(
                r == roster and u == unit for (r, _), (u, _) in held.items()
            ):
                log[change_id] = "already_placed"
            else:
                log[change_id] = "add" if now is None else "replace"
                held[roster, slot] = (unit, "")
    return sorted((r, u, s, n) for (r, s), (u, n) in held.items()), log


@pytest.fixture
def busy(spark, make):
    """Random changes; roster 1 gets a third of them."""
    rng = random.Random(11)
    units = {u: u % 2 + 1 for u in range(1, 25)}
    rosters = {r: r % 2 + 1 for r in range(1, 9)}
    slots = [(r, u, s, "old") for r in range(1, 6) for s, u in ((1, r), (4, r + 2))]
    changes = []
    for i in range(900):
        roster = 1 if rng.random() < 0.33 else rng.randrange(1, 11)
        # Few distinct times, so that the id has to decide.
        moment = START + timedelta(minutes=rng.randrange(200))
        changes.append((i, moment, roster, rng.randrange(0, 12), rng.randrange(1, 27)))
    tables = (
        make("slot", slots),
        spark.createDataFrame(changes, CHANGE).repartition(7),
        make("roster", [(r, n, "t", "Arcade", 1.0, START) for r, n in rosters.items()]),
        make("unit", [(u, n, 1, f"u{u}", 1, 1.0, 1, None) for u, n in units.items()]),
        make("nation", [(1, "a", None), (2, "b", None)]),
        make("category", [(1, "c", None)]),
    )
    return tables, one_by_one(slots, changes, rosters, units)


@pytest.mark.parametrize("store", [False, True])
def test_replay_equals_one_by_one(busy, store):
    tables, (slots, log) = busy
    result = apply_slot_changes(*tables, store=store)
    assert rows(result.slots, "roster_id", "unit_id", "slot_no", "role_note") == sorted(
        slots, key=repr
    )
    assert dict(rows(result.log, "change_id", "verdict")) == log
    assert {"add", "replace", "already_placed", "slot_range", "nation_mismatch"} <= set(log.values())


def test_two_changes_of_one_slot_and_a_moved_unit(spark, world):
    changes = spark.createDataFrame(
        [
            (1, START, 1, 1, 4),  # replaces unit 1
            (2, START + timedelta(1), 1, 5, 1),  # unit 1 is free again
            (3, START + timedelta(2), 1, 1, 1),  # now it is in slot 5
            (4, START + timedelta(3), 1, 1, 4),  # same unit, same slot
        ],
        CHANGE,
    )
    done = apply_slot_changes(
        world["slot"], changes, world["roster"], world["unit"], world["nation"], world["category"]
    )
    assert dict(rows(done.log, "change_id", "verdict")) == {
        1: "replace", 2: "add", 3: "already_placed", 4: "replace",
    }
    kept = rows(done.slots.where("roster_id = 1"), "slot_no", "unit_id", "role_note")
    assert kept == [(1, 4, ""), (10, 3, "x"), (2, 2, None), (4, 5, "of another nation"), (5, 1, "")]
    assert done.slots.where("roster_id <> 1").count() == 2


def test_no_changes_at_all(spark, world):
    done = apply_slot_changes(
        world["slot"], spark.createDataFrame([], CHANGE), world["roster"], world["unit"],
        world["nation"], world["category"],
    )
    assert rows(done.slots, "roster_id", "slot_no") == rows(world["slot"], "roster_id", "slot_no")
    assert done.log.count() == 0


def test_few_rows_of_a_hot_roster_are_walked(spark, make):
    """A third of the changes in one roster, of which only unit 500 is asked for in two slots."""
    rng = random.Random(5)
    n = 6000
    changes = []
    for i in range(n):
        roster = 1 if i % 3 == 0 else 2 + i % 900
        slot = rng.randrange(1, 11)
        unit = 500 if roster == 1 and i % 600 == 0 else slot * 20 + rng.randrange(20)
        changes.append((i, START + timedelta(seconds=i), roster, slot, unit))
    slots = [(1, 25, 1, "old")]
    rosters = {r: 1 for r in range(1, 1000)}
    units = {u: 1 for u in range(1, 501)}
    stored = make("slot", slots)
    frame = spark.createDataFrame(changes, CHANGE)
    done = apply_slot_changes(
        stored, frame,
        make("roster", [(r, 1, "t", "Arcade", 1.0, START) for r in rosters]),
        make("unit", [(u, 1, 1, f"u{u}", 1, 1.0, 1, None) for u in units]),
        make("nation", [(1, "a", None)]), make("category", [(1, "c", None)]),
    )
    expected, log = one_by_one(slots, changes, rosters, units)
    assert rows(done.slots, "roster_id", "unit_id", "slot_no", "role_note") == sorted(
        expected, key=repr
    )
    assert dict(rows(done.log, "change_id", "verdict")) == log
    pairs = contended_masks(stored, frame)
    assert rows(pairs, "roster_id", "unit_id") == [(1, 500)]
    flagged = frame.selectExpr("*", "roster_id = 1 AND unit_id = 500 AS contended")
    contended = flagged.where("contended").count()
    # Each contended change is followed by at most one free change of its slot.
    assert walk_input(stored, flagged, pairs).count() <= 2 * contended + 10


def test_a_slot_with_several_units_counts_each_of_them(spark, make, world):
    slots = make("slot", [(1, 1, 1, "a"), (1, 3, 1, "b")])
    others = (world["roster"], world["unit"], world["nation"], world["category"])
    for unit in (1, 3):
        change = spark.createDataFrame([(1, START, 1, 1, unit), (2, START, 1, 2, unit)], CHANGE)
        verdicts = dict(rows(slot_change_verdicts(change, slots, *others), "change_id", "verdict"))
        assert verdicts == {1: "replace", 2: "already_placed"}
        done = apply_slot_changes(slots, change, *others)
        assert dict(rows(done.log, "change_id", "verdict")) == verdicts
        assert rows(done.slots, "slot_no", "unit_id") == [(1, unit)]


def test_independent_slots_of_a_hot_roster_are_walked_apart(spark, make):
    """Units move between the two slots of a pair, never between pairs: five groups, the same log."""
    rng = random.Random(9)
    changes = []
    for i in range(1500):
        roster, pair = (1, rng.randrange(5)) if i % 3 == 0 else (2 + i % 50, 0)
        slot, unit = 2 * pair + rng.randrange(1, 3), 10 * pair + rng.randrange(1, 6)
        changes.append((i, START + timedelta(seconds=i // 2), roster, slot, unit))
    slots = [(1, 1, 2, "old"), (1, 44, 9, "old"), (3, 2, 1, "")]
    rosters, units = {r: 1 for r in range(1, 60)}, {u: 1 for u in range(1, 60)}
    stored, frame = make("slot", slots), spark.createDataFrame(changes, CHANGE).repartition(5)
    done = apply_slot_changes(
        stored, frame,
        make("roster", [(r, 1, "t", "Arcade", 1.0, START) for r in rosters]),
        make("unit", [(u, 1, 1, f"u{u}", 1, 1.0, 1, None) for u in units]),
        make("nation", [(1, "a", None)]), make("category", [(1, "c", None)]),
    )
    expected, log = one_by_one(slots, changes, rosters, units)
    assert dict(rows(done.log, "change_id", "verdict")) == log
    assert rows(done.slots, "roster_id", "unit_id", "slot_no", "role_note") == sorted(expected, key=repr)
    masks = contended_masks(stored, frame)
    found = {r["roster_id"]: sorted(r["_groups"]) for r in slot_groups(masks).collect()}
    assert found[1] == [0b11 << 1, 0b11 << 3, 0b11 << 5, 0b11 << 7, 0b11 << 9]
    flagged = frame.join(masks.drop("_mask").selectExpr("*", "true AS contended"), ["roster_id", "unit_id"], "left")
    walked = walk_input(stored, flagged.fillna(False, ["contended"]), masks).where("roster_id = 1")
    sizes = sorted(r["count"] for r in walked.groupBy("slots").count().collect())
    assert len(sizes) == 5 and sizes[-1] < 2 * sizes[0]


def test_one_unit_ties_slots_together(spark):
    masks = spark.createDataFrame(
        [(1, 7, 0b0011), (1, 8, 0b1100), (1, 9, 0b0110), (2, 7, 0b11), (2, 8, 0b1100), (3, 1, 0b101)],
        "roster_id long, unit_id long, _mask long",
    )
    found = {r["roster_id"]: sorted(r["_groups"]) for r in slot_groups(masks).collect()}
    assert found == {1: [0b1111], 2: [0b11, 0b1100], 3: [0b101]}
