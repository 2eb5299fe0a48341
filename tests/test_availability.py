"""Sets of available units against all pairs."""

from rosterlab.operators import availability, roster
from tests.conftest import rows


def test_sets_equal_all_pairs(spark, world, make):
    """Ids on both sides of zero and of a bitmap's end, repeated slots, rosters without units."""
    ids = [0, -1, -32767, -32768, -32769, 1, 32768, 32769, 65536, 65537, 10**9]
    units = world["unit"].union(make("unit", [(i, 1, 1, f"u{i}", 1, 1.0, 1, None) for i in ids if not 1 <= i <= 9]))
    slots = world["slot"].union(make("slot", [(1, 32768, 5, ""), (1, 32768, 6, ""), (2, 0, 1, ""), (2, -32768, 2, "")]))
    sets = availability.available_sets(world["roster"], units, world["nation"], slots, world["category"])
    counts = roster.available_counts(world["roster"], units, world["nation"], slots, world["category"])
    assert rows(sets, "roster_id", "available_count") == rows(counts, "roster_id", "available_count")
    bitmaps = availability.nation_bitmaps(units, world["nation"], world["category"])
    got = rows(availability.unfolded(sets, bitmaps), "roster_id", "unit_id")
    listed = rows(units.where("category_id < 4"), "nation_id", "unit_id")
    held = set(rows(slots, "roster_id", "unit_id"))
    want = [
        (r, u) for r, n in rows(world["roster"], "roster_id", "nation_id") for m, u in listed
        if m == n and (r, u) not in held
    ]
    assert got == sorted(want, key=repr)


def test_a_set_is_small_however_large_the_nation(spark, make, world):
    units = spark.range(1, 200_001).selectExpr(
        "id AS unit_id", "1 AS nation_id", "1 AS category_id", "'u' AS name", "1 AS tier", "1D AS rating", "1 AS cost",
        "CAST(NULL AS STRING) AS media_path",
    )
    sets = availability.available_sets(world["roster"], units, world["nation"], world["slot"], world["category"])
    found = {r["roster_id"]: (r["available_count"], r["held"]) for r in sets.collect()}
    assert found[1] == (199_996, [1, 2, 3, 5]) and found[2] == (200_000, []) and found[4] == (0, [])
    assert availability.nation_bitmaps(units, world["nation"], world["category"]).count() == 7
