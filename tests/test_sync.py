from rosterlab.functions import fixed_values as fv
from rosterlab.operators.sync import UnitSync, refresh, sync_dims
from tests.conftest import rows

PROVIDED = (
    "position long, preferred_id long, nation_id int, category_id int, name string, tier int, "
    "rating double, cost int, media_path string, front int, side int, rear int, "
    "munition_name string, munition_kind string, pen int"
)


def offer(position, preferred, name, nation=1, path="p.png"):
    return (position, preferred, nation, 1, name, 1, 2.0, 3, path, 7, 7, 7, "s", "k", 70)


def synced(spark, world, *offers):
    return UnitSync(
        world["unit"], world["spec"], world["munition"],
        spark.createDataFrame(list(offers), PROVIDED), world["nation"], world["category"],
    )


def test_stored_units_only_get_an_unset_path(spark, world):
    done = synced(
        spark, world,
        offer(1, 77, "Alpha"), offer(2, 78, "Beta"), offer(3, 79, "Gamma"), offer(4, 80, "delta"),
        offer(5, 81, "ALPHA"),
    )
    paths = dict(rows(done.unit, "unit_id", "media_path"))
    assert {i: paths[i] for i in (1, 2, 3, 4, 5)} == {
        1: "a.png", 2: "p.png", 3: "p.png", 4: "p.png", 5: "x/alpha.png",
    }
    # The match is case-sensitive: ALPHA is a new unit with the id it prefers.
    assert rows(done.unit.where("unit_id > 9"), "unit_id", "name") == [(81, "ALPHA")]


def test_ids_free_preferred_first_then_after_the_highest(spark, world):
    done = synced(
        spark, world,
        offer(1, 1, "wants 1"), offer(2, 50, "gets 50"), offer(3, 50, "wants 50 too"),
        offer(4, 20, "gets 20"), offer(5, None, "wants none"),
    )
    new = dict(rows(done.unit.where("unit_id > 9"), "name", "unit_id"))
    assert new == {
        "gets 50": 50, "gets 20": 20, "wants 1": 51, "wants 50 too": 52, "wants none": 53,
    }


def test_missing_parts_are_added_and_existing_ones_kept(spark, world):
    done = synced(spark, world, offer(1, 1, "Alpha"), offer(2, 3, "Gamma"),
                  offer(3, 7, "Eta\\x", nation=2), offer(4, 90, "brand new"))
    specs = dict(rows(done.spec, "unit_id", "front"))
    assert (specs[1], specs[3], specs[7], specs[90]) == (100, 7, 2, 7)
    shots = rows(done.munition.where("munition_id > 9"), "munition_id", "unit_id", "pen")
    assert shots == [(10, 7, 70), (11, 90, 70)]


def test_repeated_offers_fill_the_path_in_order(spark, world):
    default = fv.DEFAULT_MEDIA_PATH
    done = synced(
        spark, world,
        offer(1, 30, "n1", path=None), offer(2, 31, "n1", path="first"), offer(3, 32, "n1", path="x"),
        offer(4, 40, "n2", path=default), offer(5, 41, "n2", path=" "),
        offer(6, 42, "Beta", path=default), offer(7, 43, "Beta", path="late"),
    )
    paths = dict(rows(done.unit, "name", "media_path"))
    assert (paths["n1"], paths["n2"], paths["Beta"]) == ("first", " ", "late")
    assert done.unit.count() == world["unit"].count() + 2


def test_syncing_twice_equals_once(spark, world):
    offers = [offer(1, 1, "w"), offer(2, 50, "v"), offer(3, 50, "u"), offer(4, 2, "Beta")]
    once = synced(spark, world, *offers)
    state = {"unit": once.unit, "spec": once.spec, "munition": once.munition}
    twice = synced(spark, world | state, *offers)
    for name, before in state.items():
        assert rows(getattr(twice, name)) == rows(before)


def test_dims_insert_only_and_refuse_taken_names(spark, world):
    provided = spark.createDataFrame(
        [
            (1, 1, "Renamed", "other.png"),
            (2, 3, "Third", "c.png"),
            (3, 3, "Third again", "c2.png"),
            (4, 4, "Elbonia", "d.png"),
            (5, 5, "Third", "e.png"),
        ],
        "position long, nation_id int, name string, flag_path string",
    )
    done = sync_dims(world["nation"], provided, "nation_id")
    assert rows(done.table) == [
        (1, "Germany", "a.png"), (2, "Elbonia", None), (3, "Third", "c.png"),
    ]
    assert rows(done.rejected) == [(4, "Elbonia", "name_taken"), (5, "Third", "name_taken")]
    again = sync_dims(done.table, provided, "nation_id")
    assert rows(again.table) == rows(done.table)


def test_refresh_runs_all_three_steps(spark, world):
    provided = {
        "nation": spark.createDataFrame(
            [(1, 3, "Third", None)], "position long, nation_id int, name string, flag_path string"
        ),
        "category": spark.createDataFrame(
            [(1, 9, "Ninth", None)],
            "position long, category_id int, name string, description string",
        ),
        "unit": spark.createDataFrame([offer(1, 60, "n", path=" ")], PROVIDED),
    }
    paths = spark.createDataFrame([("n", "n.png"), ("Beta", "b.png")], "name string, path string")
    new = refresh(world, provided, paths)
    assert rows(new["nation"], "nation_id") == [(1,), (2,), (3,)]
    assert rows(new["category"], "category_id") == [(1,), (2,), (3,), (9,)]
    found = dict(rows(new["unit"], "unit_id", "media_path"))
    assert (found[60], found[2], found[1]) == ("n.png", "b.png", "a.png")
    assert found[8] == fv.DEFAULT_MEDIA_PATH
    assert new["spec"].count() == 7


def test_dims_without_id_or_name_are_refused(spark):
    schema = "nation_id int, name string, flag string"
    stored = spark.createDataFrame([(1, "a", None)], schema)
    provided = spark.createDataFrame(
        [(0, 2, None, None), (1, None, "zz", None), (2, 3, "ok", None), (3, 1, None, None), (4, 2, "b", None)],
        "position int, " + schema,
    )
    done = sync_dims(stored, provided, "nation_id")
    assert sorted(r["nation_id"] for r in done.table.collect()) == [1, 2, 3]
    assert sorted(map(tuple, done.rejected.collect()), key=repr) == [
        (2, None, "name_missing"),
        (None, "zz", "id_missing"),
    ]


def test_units_that_break_a_rule_are_refused(spark, world):
    def broken(position, called, **values):
        names = [field.split()[0] for field in PROVIDED.split(", ")]
        row = dict(zip(names, offer(position, 100 + position, called), strict=True)) | values
        return tuple(row[n] for n in names)

    faults = [
        ("name_missing", {"name": None}), ("value_missing", {"nation_id": None}),
        ("value_missing", {"tier": None}), ("tier_range", {"tier": 99}),
        ("rating_low", {"rating": -3.0}), ("cost_negative", {"cost": -1}),
        ("armor_negative", {"side": -1}), ("pen_negative", {"pen": -1}),
        ("nation_missing", {"nation_id": 77}), ("category_missing", {"category_id": 5555}),
    ]
    offers = [broken(i, f"bad {i}", **values) for i, (_, values) in enumerate(faults)]
    # For a stored unit only what it lacks is looked at: Alpha has a spec and a munition.
    offers += [broken(50, "Alpha", tier=99, side=-1, pen=None), broken(51, "bad 3")]
    done = synced(spark, world, *offers)
    assert rows(done.rejected, "position", "reason") == sorted(
        ((i, reason) for i, (reason, _) in enumerate(faults)), key=repr
    )
    # The later row of the same name is valid and gives the values.
    assert rows(done.unit.where("unit_id > 9"), "unit_id", "name", "tier") == [(151, "bad 3", 1)]
    assert done.spec.where("unit_id > 9").count() == 1
    assert done.munition.where("unit_id > 9").count() == 1
