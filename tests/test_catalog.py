from datetime import datetime

import pytest

from rosterlab.operators import catalog
from tests.conftest import rows


def search(world, **filters):
    found = catalog.unit_search(world["unit"], world["nation"], world["category"], **filters)
    return [r["unit_id"] for r in found.collect()]


def test_lists_are_sorted_by_label_and_id(world):
    assert [r["name"] for r in catalog.nation_list(world["nation"]).collect()] == ["Elbonia", "독일"]
    assert [r["name"] for r in catalog.category_list(world["category"]).collect()] == [
        "자주대공포", "Walker", "중형전차",
    ]


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        ({}, [8, 7, 5, 6, 3, 4, 2, 1]),
        ({"nation_id": 1}, [3, 4, 2, 1]),
        ({"nation_id": 0, "keyword": ""}, [8, 7, 5, 6, 3, 4, 2, 1]),
        ({"category_id": 3}, [8, 7, 3, 4]),
        ({"rating_min": 5.3, "rating_max": 6.7}, [5, 2, 1]),
        ({"rating_max": 0.0}, []),
        ({"keyword": "ALPHA"}, [5, 1]),
        ({"keyword": "_50%"}, [6]),
        ({"keyword": "\\"}, [7]),
        ({"nation_id": 1, "category_id": 3, "rating_min": 4.5, "keyword": "L"}, [4]),
    ],
)
def test_search_filters(world, filters, ids):
    assert search(world, **filters) == ids


def test_search_hides_units_without_category(world):
    assert 9 not in search(world)


def test_detail_keeps_units_without_parts_and_fans_out(world):
    detail = catalog.unit_detail(
        world["unit"], world["nation"], world["category"], world["spec"], world["munition"]
    )
    got = rows(detail, "unit_id", "front", "munition_name")
    assert got == sorted(
        [(1, 100, "shot one"), (2, 80, "shot two"), (3, None, "no spec"), (4, 75, "shot four"),
         (5, 40, "a"), (5, 40, "b"), (6, 1, "z"), (7, 2, None), (8, None, None)],
        key=repr,
    )


def test_munitions_put_representative_first(world):
    listed = catalog.unit_munitions(world["munition"]).collect()
    assert [r["munition_id"] for r in listed if r["unit_id"] in (4, 5)] == [3, 4, 6, 5]


def test_picklist_starts_with_the_all_row(world):
    options = catalog.picklist(world["nation"], "nation_id", "name", all_label="every")
    assert rows(options) == [(0, "", "every"), (1, "1", "Germany"), (1, "2", "Elbonia")]
    assert catalog.picklist(world["nation"], "nation_id", "name").count() == 2


def test_dashboard(world, make):
    args = (world["unit"], world["nation"], world["category"])
    assert tuple(catalog.dashboard_summary(*args, world["roster"]).first()) == (8, 4, 2, "newest")
    empty = make("roster", [])
    assert tuple(catalog.dashboard_summary(*args, empty).first()) == (8, 0, 2, "-")


def test_newest_roster_tie_is_decided_by_id(make, world):
    same = datetime(2024, 5, 5)
    rosters = make(
        "roster",
        [(7, 1, "seven", "Arcade", 1.0, same), (9, 1, "nine", "Arcade", 1.0, same)],
    )
    args = (world["unit"], world["nation"], world["category"])
    assert catalog.dashboard_summary(*args, rosters).first()["newest_title"] == "nine"
