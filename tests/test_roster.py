from pyspark.sql import functions as F

from rosterlab.operators import catalog, roster
from tests.conftest import rows


def detail(world, sort=True):
    return roster.roster_detail(
        world["roster"], world["nation"], world["slot"], world["unit"], world["category"], sort=sort
    )


def test_list_is_newest_first_and_zero_means_all(world):
    listed = roster.roster_list(world["roster"], world["nation"], nation_id=0).collect()
    assert [r["roster_id"] for r in listed] == [4, 3, 2, 1]
    assert listed[-1]["nation"] == "독일"
    assert rows(roster.roster_list(world["roster"], world["nation"], 1), "roster_id") == [(1,), (2,)]
    assert rows(roster.roster_list(world["roster"], world["nation"], roster_id=3), "title") == [
        ("foreign only",)
    ]


def test_a_duplicate_slot_shows_the_highest_unit(world, make):
    slots = make("slot", [(1, 1, 1, None), (1, 2, 1, None), (1, 3, 11, None)])
    grid = roster.slot_grid(
        world["roster"], world["nation"], slots, world["unit"], world["category"]
    )
    assert rows(grid.where("unit_id IS NOT NULL"), "roster_id", "slot_no", "unit_id") == [(1, 1, 2)]


def test_detail_drops_foreign_slots(world):
    got = [(r["roster_id"], r["slot_no"], r["unit_id"]) for r in detail(world).collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (1, 10, 3), (4, 3, 7)]


def test_summary_keeps_empty_and_foreign_rosters(world):
    summary = roster.roster_summary(world["roster"], world["nation"], world["slot"], world["unit"])
    got = rows(summary, "roster_id", "unit_count", "average_rating", "cap_same_nation", "total_cost")
    assert got == [
        (1, 3, 5.0, 5.7, 8100),
        (2, 0, None, None, None),
        (3, 0, None, None, None),
        (4, 1, 4.6, 4.6, 400),
    ]
    caps = dict(rows(roster.roster_cap_list(summary)))
    assert caps == {1: "5.7", 2: "-", 3: "-", 4: "4.6"}
    assert rows(roster.roster_cards(summary))[:2] == [
        (1, "5.7", "5.0", 8100, 3), (2, "-", "-", 0, 0),
    ]


def test_cap_over_all_slots_ignores_the_nation(world):
    assert rows(roster.roster_cap(world["slot"], world["unit"])) == [(1, 6.7), (3, 5.7), (4, 4.6)]


def test_category_counts_merge_equal_labels(world):
    labels = {"SPAA": "same", "Walker": "same"}
    counts = roster.category_counts(
        world["roster"], world["slot"], world["unit"], world["category"], labels
    )
    assert [tuple(r) for r in counts.collect()] == [
        (1, "same", 2), (1, "Medium Tank", 1), (4, "Medium Tank", 1),
    ]


def test_grid_has_ten_rows_per_roster(world):
    grid = roster.slot_grid(
        world["roster"], world["nation"], world["slot"], world["unit"], world["category"]
    )
    assert rows(grid.groupBy("roster_id").count()) == [(i, 10) for i in (1, 2, 3, 4)]
    filled = rows(grid.where("unit_id IS NOT NULL"), "roster_id", "slot_no", "unit_name")
    assert filled == [(1, 1, "Alpha"), (1, 10, "Gamma"), (1, 2, "Beta"), (4, 3, "Eta\\x")]


def test_occupancy(world, make):
    slots = world["slot"].union(make("slot", [(2, 1, 99, "outside"), (2, 1, 0, "outside")]))
    taken = roster.slot_occupancy(world["roster"], slots)
    assert taken.count() == 40
    assert rows(taken.where("is_taken"), "roster_id", "slot_no") == [
        (1, 1), (1, 10), (1, 2), (1, 4), (3, 1), (4, 3),
    ]


def test_available_units_and_counts_agree(world):
    listed = catalog.unit_search(world["unit"], world["nation"], world["category"], sort=False)
    free = roster.available_units(world["roster"], listed, world["unit"], detail(world))
    assert rows(free.where("roster_id = 1"), "unit_id") == [(4,)]
    held = detail(world).select("roster_id", "unit_id")
    assert free.join(held, ["roster_id", "unit_id"], "left_semi").isEmpty()
    known = catalog.known_units(world["unit"], world["nation"], world["category"])
    counts = roster.available_counts(
        world["roster"], world["unit"], world["nation"], world["slot"], world["category"]
    )
    per_roster = free.groupBy("roster_id").agg(F.count(F.lit(1)).alias("n"))
    assert rows(counts) == rows(per_roster)


def test_use_and_selection(world, spark):
    used = roster.units_in_use(world["unit"], world["slot"])
    assert rows(used, "unit_id") == [(1,), (2,), (3,), (5,), (7,)]
    asked = spark.createDataFrame([(1, 1), (1, 2), (99, 1)], "roster_id long, nation_id int")
    assert rows(roster.stale_selection(asked, world["roster"])) == [(1, 2), (99, 1)]


def test_latest_roster_per_nation(world):
    latest = roster.latest_roster_per_nation(world["roster"])
    assert rows(latest, "nation_id", "roster_id", "title") == [(1, 2, "empty"), (2, 4, "newest")]


def test_slots_come_in_slot_order(world):
    listed = roster.roster_slots(world["slot"]).collect()
    assert [(r["roster_id"], r["slot_no"]) for r in listed] == [
        (1, 1), (1, 2), (1, 4), (1, 10), (3, 1), (4, 3),
    ]
