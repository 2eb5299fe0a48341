import random
from datetime import datetime, timedelta

import pytest

from rosterlab.operators.mixed import apply_mixed_changes
from tests.conftest import rows

START = datetime(2024, 1, 1)
CHANGE = "change_id long, change_ts timestamp_ntz, roster_id long, slot_no int, unit_id long, kind string"


def one_by_one(slots, changes, rosters, units):
    """The same log in plain Python; a stored slot may hold several units."""
    held: dict = {}
    for roster, unit, slot, note in slots:
        held.setdefault((roster, slot), []).append((unit, note))
    log = {}
    for change_id, _, roster, slot, unit, kind in sorted(changes, key=lambda c: (c[1], c[0])):
        if kind == "remove_unit":
            log[change_id] = "remove"
            for (r, s), inside in held.items():
                if r == roster:
                    held[r, s] = [x for x in inside if x[0] != unit]
        elif kind == "remove_slot":
            log[change_id] = "remove"
            held.pop((roster, slot), None)
        elif kind != "place":
            log[change_id] = "kind_unknown"
        elif roster not in rosters:
            log[change_id] = "roster_missing"
        elif unit not in units:
            log[change_id] = "unit_missing"
        elif rosters[roster] != units[unit]:
            log[change_id] = "nation_mismatch"
        elif not 1 <= slot <= 10:
            log[change_id] = "slot_range"
        else:
            now = [u for u, _ in held.get((roster, slot), [])]
            inside = [u for (r, _), xs in held.items() if r == roster for u, _ in xs]
            if unit not in now and unit in inside:
                log[change_id] = "already_placed"
            else:
                log[change_id] = "replace" if now else "add"
                held[roster, slot] = [(unit, "")]
    return sorted((r, u, s, n) for (r, s), xs in held.items() for u, n in xs), log


@pytest.mark.parametrize("seed, numbers", [(3, 25), (4, 60)])
def test_mixed_log_equals_one_by_one(spark, make, seed, numbers):
    rng = random.Random(seed)
    units = {u: u % 2 + 1 for u in range(1, numbers)}
    rosters = {r: r % 2 + 1 for r in range(1, 9)}
    slots = [
        (r, u, s, "old") for r in range(1, 6) for s, u in ((1, r), (4, r + 2), (4, r + 4), (7, r + 8))
    ]
    changes = []
    for i in range(1200):
        roster = 1 if rng.random() < 0.33 else rng.randrange(1, 11)
        moment = START + timedelta(minutes=rng.randrange(200))
        kind = rng.choices(["place", "remove_unit", "remove_slot", "other", None], [14, 3, 3, 1, 1])[0]
        slot, unit = rng.randrange(0, 12), rng.randrange(1, numbers + 2)
        changes.append((i, moment, roster, slot, unit, kind))
    want, log = one_by_one(slots, changes, rosters, units)
    result = apply_mixed_changes(
        make("slot", slots),
        spark.createDataFrame(changes, CHANGE).repartition(7),
        make("roster", [(r, n, "t", "Arcade", 1.0, START) for r, n in rosters.items()]),
        make("unit", [(u, n, 1, f"u{u}", 1, 1.0, 1, None) for u, n in units.items()]),
        make("nation", [(1, "a", None), (2, "b", None)]),
        make("category", [(1, "c", None)]),
    )
    assert dict(rows(result.log, "change_id", "verdict")) == log
    assert sorted(rows(result.slots, "roster_id", "unit_id", "slot_no", "role_note")) == want
    assert {"add", "replace", "already_placed", "remove", "kind_unknown"} <= set(log.values())


def test_empty_log_leaves_the_slots(spark, world):
    none = spark.createDataFrame([], CHANGE)
    result = apply_mixed_changes(
        world["slot"], none, world["roster"], world["unit"], world["nation"], world["category"]
    )
    assert rows(result.slots) == rows(world["slot"].select(*result.slots.columns))
    assert result.log.count() == 0
