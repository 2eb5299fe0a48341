"""Slots as the state of a stream, against the log applied one change after the other."""

import random
from datetime import timedelta

import pandas as pd
import pytest

from rosterlab.streaming.live import ChangeIds, LiveSlots, RosterState, _Processor
from tests.conftest import rows
from tests.test_mixed import CHANGE, START, one_by_one

SLOT = ("roster_id", "unit_id", "slot_no", "role_note")


@pytest.fixture
def feed(spark, make, tmp_path):
    """feed(slots, rosters, units) and then deliver(changes): each delivery is one micro-batch."""

    def build(slots, rosters, units, **how):
        tables = (
            make("roster", [(r, n, "t", "Arcade", 1.0, START) for r, n in rosters.items()]),
            make("unit", [(u, n, 1, f"u{u}", 1, 1.0, 1, None) for u, n in units.items()]),
            make("nation", [(1, "a", None), (2, "b", None)]),
            make("category", [(1, "c", None)]),
        )
        kept = LiveSlots(str(tmp_path / "target"), make("slot", slots), *tables, **how)

        def deliver(changes):
            inbox = str(tmp_path / "inbox")
            spark.createDataFrame(changes, CHANGE).repartition(3).write.mode("append").parquet(inbox)
            kept.run(spark.readStream.schema(CHANGE).parquet(inbox)).awaitTermination()
            return kept

        return deliver

    return build


def test_deliveries_equal_one_by_one(feed):
    rng = random.Random(6)
    units = {u: u % 2 + 1 for u in range(1, 20)}
    rosters = {r: r % 2 + 1 for r in range(1, 7)}
    slots = [(r, u, s, "old") for r in range(1, 5) for s, u in ((1, r), (4, r + 2), (4, r + 4), (7, r + 8))]
    changes = []
    for i in range(400):
        roster = 1 if rng.random() < 0.33 else rng.randrange(1, 8)
        kind = rng.choices(["place", "remove_unit", "remove_slot", "other", None], [14, 3, 3, 1, 1])[0]
        moment = START + timedelta(minutes=i // 3)
        changes.append((i, moment, roster, rng.randrange(0, 12), rng.randrange(1, 21), kind))
    want, log = one_by_one(slots, changes, rosters, units)
    deliver = feed(slots, rosters, units)
    parts = [changes[:150], changes[150:151], changes[100:300], [*changes[300:], *changes[390:]], changes[:50]]
    for part in parts:
        rng.shuffle(part)
        kept = deliver(part)
    assert dict(rows(kept.log(), "change_id", "verdict")) == log
    assert kept.log().count() == len(changes)  # what came twice counts once
    assert rows(kept.slots(), *SLOT) == sorted(want, key=repr)


def test_odd_changes_and_late_ones(spark, feed):
    deliver = feed([(1, 3, None, "no number"), (1, 5, 2, None), (2, None, 1, "")], {1: 1, 2: 1}, {3: 1, 5: 1, 7: 1})
    later = START + timedelta(days=1)
    kept = deliver(
        [(1, later, 1, 4, 7, "place"), (2, START, None, 1, 7, "place"), (3, START, 9, 1, 7, "place"),
         (None, START, 1, 1, 7, "place"), (4, None, 1, 1, 7, "place"), (5, later, 1, 6, 3, "place")]
    )
    log = {(1, "add"), (2, "roster_missing"), (3, "roster_missing"), (5, "already_placed")}
    assert set(rows(kept.log(), "change_id", "verdict")) == log
    kept = deliver(
        [(6, START, 1, 4, 5, "place"), (7, START, 1, None, 7, "remove_unit"), (8, later, 1, None, 3, "remove_unit"),
         (9, START, 1, 4, None, "remove_slot"), (10, START, 1, None, 77, "remove_unit")]
    )
    log |= {(6, "stale"), (7, "stale"), (8, "remove"), (9, "stale"), (10, "remove")}
    assert set(rows(kept.log(), "change_id", "verdict")) == log
    assert rows(kept.slots(), *SLOT) == sorted([(1, 5, 2, None), (1, 7, 4, ""), (2, None, 1, "")], key=repr)


def test_rosters_share_the_keys_of_the_state(spark, feed):
    """A call into Python for each roster takes longer than the changes; ids stay exact beside nulls."""
    large = (1 << 53) + 1
    slots = [(r, 3, 1, None) for r in range(1, 301)] + [(large, 5, 2, "x"), (large, None, 2, None)]
    deliver = feed(slots, {r: 1 for r in range(1, 301)} | {large: 1}, {3: 1, 5: 1, large: 1}, parts=4)
    kept = deliver(
        [(1, START, large, 4, large, "place"), (2, START, None, 1, None, "remove_slot"), (3, START, 7, 1, None, "remove_slot")]
        + [(10 + r, START, r, 6, 5, "place") for r in range(20, 60)]
    )
    state = spark.read.format("statestore").option("path", kept._progress).option("stateVarName", "slots").load()
    assert state.select("key").distinct().count() <= 4
    want = [s for s in slots if s[0] != 7] + [(r, 5, 6, "") for r in range(20, 60)] + [(large, large, 4, "")]
    assert rows(kept.slots(), *SLOT) == sorted(want, key=repr)
    assert rows(kept.log().where("change_id < 10"), "change_id", "roster_id", "verdict") == [
        (1, large, "add"), (2, None, "remove"), (3, 7, "remove")
    ]


def test_an_emptied_slot_keeps_its_stamp():
    state = RosterState({1: ([4], ["x"], None)})
    assert state.apply("remove_slot", 1, None, (10, 1)) == "remove"
    assert state.apply("place", 1, 4, (9, 2)) == "stale"
    assert state.apply("place", 1, 4, (11, 3)) == "add"
    assert state.apply("place", 2, 4, (12, 4)) == "already_placed"
    assert state.slots == {1: ([4], [""], (11, 3))} and state.touched == {1}


class Entries:
    """A map of the state that counts the calls."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.kept[key]


def test_a_chunk_of_changes_takes_a_few_calls():
    """A call into the state for each change took longer than all else."""
    step = _Processor()
    step.start, step.held, step.seen = Entries(), Entries(), Entries()
    step.start.kept[(5,)] = ('{"roster_id":[1,2,1],"slot_no":[1,1,2],"unit_id":[7,8,null],"role_note":["x",null,"y"]}',)

    def given(ids):
        made = [(i, i, True, 1 + i % 2 * 2, 4 + i % 3, False, 100 + i, "place", None, 5) for i in ids]
        names = ["change_id", "changed_us", "known", "roster_id", "slot_no", "no_unit", "unit_id", "kind", "reason", "chunk"]
        return pd.concat(step.handleInputRows((0,), iter([pd.DataFrame(made, columns=names)]), None))

    assert len(given(range(600))) == 600
    assert step.start.calls + step.held.calls + step.seen.calls <= 6
    assert step.start.kept == {(5,): ('{"roster_id":[2],"slot_no":[1],"unit_id":[8],"role_note":[null]}',)}
    before = step.held.calls
    assert len(given(range(300, 600))) == 0 and step.held.calls == before + 1
    assert sorted(given(range(500, 700))["change_id"]) == list(range(600, 700))


def test_ids_of_a_busy_roster_lie_in_blocks():
    rng = random.Random(3)
    blocks, known = Entries(), set()
    ids = ChangeIds(blocks, (5, True, 1), [], 0, 0)
    for count in (500, 500, 1000, 9000, 40000, 3):
        some = [rng.randrange(60000) * 4096 - (1 << 27) for _ in range(count)] + [-(1 << 63), (1 << 63) - 1]
        fresh = []
        for i in some:
            fresh.append(i not in known)
            known.add(i)
        assert ids.take(some) == fresh and ids.count == len(known)
        ids = ChangeIds(blocks, ids.key, ids.ids, ids.bits, ids.count)
    assert ids.bits and not ids.ids and {key[3] for key in blocks.kept} == {ids.bits}
    assert max(len(value) for value, in blocks.kept.values()) <= 8 * 2048
    before = blocks.calls
    assert ids.take([1, 2, 3]) == [True] * 3
    assert blocks.calls - before <= 6


def test_slots_before_the_feed_stay_packed(spark, feed):
    """Every note and number comes back, of rosters with changes and of those without."""
    notes = ['a"b\\n\u0001', "é😀", "", None, "null", "[1,2]"]
    large = (1 << 62) + 1
    slots = [(large + r, large - r, r % 5, notes[r % 6]) for r in range(90)] + [(large, None, None, "x"), (large + 1, 3, 9, None)]
    deliver = feed(slots, {large + r: 1 for r in range(90)}, {5: 1}, parts=2, chunks=3)
    kept = deliver([(1, START, large, 7, 5, "place"), (2, START, large + 2, 2, None, "remove_slot")])
    want = [s for s in slots if s[:1] + s[2:3] != (large + 2, 2)] + [(large, 5, 7, "")]
    assert rows(kept.slots(), *SLOT) == sorted(want, key=repr)
    for name, rosters in (("start", 88), ("slots", 2)):
        state = spark.read.format("statestore").option("path", kept._progress).option("stateVarName", name).load()
        assert state.count() <= 6
        packed = "from_json(user_map_value.held, 'struct<roster_id: array<bigint>>').roster_id"
        live = "from_json(user_map_value.held, 'array<struct<roster_id: bigint>>').roster_id"
        held = state.selectExpr(f"explode({packed if name == 'start' else live}) AS roster_id")
        assert held.distinct().count() == rosters
