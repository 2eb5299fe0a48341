from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rosterlab.operators import changes
from rosterlab.sources.tables import append_rows
from tests.conftest import rows

BATCH = (
    "request_id long, nation_id int, category_id int, name string, tier int, rating double, "
    "cost int, media_path string, front int, side int, rear int, munition_name string, "
    "munition_kind string, pen int"
)


def request(number, name, nation=1, category=1, tier=1, rating=2.0, cost=5, front=1, pen=9, **more):
    shot = more.get("shot", "shot")
    return (number, nation, category, name, tier, rating, cost, None, front, 1, 1, shot, None, pen)


def register(spark, world, *requests):
    return changes.register_units(
        spark.createDataFrame(list(requests), BATCH),
        world["unit"],
        world["munition"],
        world["nation"],
        world["category"],
    )


def test_register_assigns_ids_and_splits(spark, world):
    done = register(
        spark, world, request(8, " New B "), request(3, "New A", cost=None), request(9, "Alpha")
    )
    assert rows(done.accepted, "request_id", "unit_id", "munition_id", "name", "cost") == [
        (3, 10, 10, "New A", 0), (8, 11, 11, "New B", 5),
    ]
    assert rows(done.rejected, "request_id", "reason") == [(9, "name_taken")]
    new = done.tables()
    assert rows(new["spec"]) == [(10, 1, 1, 1), (11, 1, 1, 1)]
    assert rows(new["munition"]) == [(10, 10, "shot", "", 9, True), (11, 11, "shot", "", 9, True)]
    grown = append_rows(world["unit"], new["unit"])
    assert grown.columns == world["unit"].columns
    assert grown.count() == 11


@pytest.mark.parametrize(
    ("bad", "reason"),
    [
        (request(1, "  "), "name_missing"),
        (request(1, None), "name_missing"),
        (request(1, "x", rating=None), "value_missing"),
        (request(1, "x", shot=None), "value_missing"),
        (request(1, "ALPHA"), "name_taken"),
        (request(1, "ALPHA", tier=99), "name_taken"),
        (request(1, "x", tier=0), "tier_range"),
        (request(1, "x", tier=9), "tier_range"),
        (request(1, "x", rating=0.99), "rating_low"),
        (request(1, "x", cost=-1), "cost_negative"),
        (request(1, "x", front=-1), "armor_negative"),
        (request(1, "x", pen=-1), "pen_negative"),
        (request(1, "x", nation=77), "nation_missing"),
        (request(1, "x", category=77), "category_missing"),
    ],
)
def test_register_reasons(spark, world, bad, reason):
    done = register(spark, world, bad)
    assert done.accepted.count() == 0
    assert rows(done.rejected, "reason") == [(reason,)]


def test_first_valid_row_of_a_name_wins(spark, world):
    done = register(
        spark,
        world,
        request(1, "twin", tier=0),
        request(2, "Twin"),
        request(3, "TWIN"),
        request(4, "twin", tier=0),
        request(5, "twin", nation=2),
    )
    assert rows(done.accepted, "request_id") == [(2,), (5,)]
    assert rows(done.rejected, "request_id", "reason") == [
        (1, "tier_range"), (3, "name_taken_in_batch"), (4, "name_taken_in_batch"),
    ]


def test_delete_refuses_used_units_and_cascades(spark, world):
    asked = spark.createDataFrame([(1,), (4,), (6,), (4,), (999,)], "unit_id long")
    done = changes.delete_units(
        asked, world["unit"], world["spec"], world["munition"], world["slot"]
    )
    assert rows(done.rejected) == [(1, "in_use")]
    assert rows(done.unit, "unit_id") == [(i,) for i in (1, 2, 3, 5, 7, 8, 9)]
    assert rows(done.spec, "unit_id") == [(1,), (2,), (5,), (7,)]
    assert rows(done.munition, "munition_id") == [(1,), (2,), (5,), (6,), (8,), (9,)]


def test_create_rosters(spark, world):
    batch = spark.createDataFrame(
        [
            (5, 1, "  kept\t", "Arcade", 1.0),
            (4, 1, " \n", "Arcade", 1.0),
            (3, 9, "x", "Arcade", 1.0),
            (2, 1, "x", "Other", 1.0),
            (1, 1, "x", "Realistic", 0.5),
            (0, 2, "also kept", "Simulator", 3.0),
            (6, 1, None, "Arcade", 1.0),
        ],
        "request_id long, nation_id int, title string, game_mode string, target_rating double",
    )
    when = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    done = changes.create_rosters(batch, world["roster"], world["nation"], when)
    assert rows(done.created, "roster_id", "title", "created_at") == [
        (5, "also kept", datetime(2024, 1, 1)), (6, "kept", datetime(2024, 1, 1)),
    ]
    assert done.created.columns == world["roster"].columns
    assert rows(done.rejected) == [
        (1, "target_low"), (2, "mode_unknown"), (3, "nation_missing"), (4, "title_blank"),
        (6, "title_blank"),
    ]
    now = changes.create_rosters(batch, world["roster"], world["nation"]).created.first()
    assert isinstance(now["created_at"], datetime)


def test_slot_change_verdicts_check_in_order(spark, world):
    asked = [
        (1, 99, 1, 1, "roster_missing"),
        (2, 1, 1, 999, "unit_missing"),
        (3, 3, 1, 9, "unit_missing"),  # its category does not exist
        (4, 1, 1, 8, "nation_mismatch"),
        (5, 1, 11, 4, "slot_range"),
        (6, 1, 0, 4, "slot_range"),
        (7, 1, 3, 1, "already_placed"),
        (8, 1, 2, 1, "already_placed"),
        (9, 1, 1, 1, "replace"),
        (10, 1, 1, 4, "replace"),
        (11, 1, 3, 4, "add"),
        (12, 2, 1, 1, "add"),
        (13, 99, 99, 999, "roster_missing"),
        (14, 1, None, 4, "slot_range"),
    ]
    df = spark.createDataFrame(
        [a[:4] for a in asked], "change_id long, roster_id long, slot_no int, unit_id long"
    )
    got = changes.slot_change_verdicts(
        df, world["slot"], world["roster"], world["unit"], world["nation"], world["category"]
    )
    assert dict(rows(got, "change_id", "verdict")) == {a[0]: a[4] for a in asked}


def test_remove_slots(spark, world):
    gone = spark.createDataFrame([(1, 1, 10), (1, 1, 10), (9, 9, 9)],
                                 "roster_id long, unit_id long, slot_no int")
    left = changes.remove_slots(world["slot"], gone)
    assert rows(left, "roster_id", "slot_no") == [(1, 10), (1, 2), (1, 4), (3, 1), (4, 3)]
    left = changes.remove_slots(world["slot"], gone, by=("roster_id", "slot_no"))
    assert rows(left, "roster_id", "slot_no") == [(1, 1), (1, 2), (1, 4), (3, 1), (4, 3)]
