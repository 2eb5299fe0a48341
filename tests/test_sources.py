import pytest

from rosterlab.operators import changes
from rosterlab.schemas import TABLES
from rosterlab.sources import tables
from tests.conftest import rows


def test_round_trip_and_seed_guard(spark, world, tmp_path):
    root = str(tmp_path / "store")
    assert tables.seed(spark, root, world) is True
    stored = tables.read_catalogue(spark, root)
    for name in TABLES:
        assert rows(getattr(stored, name)) == rows(world[name])
    assert tables.seed(spark, root, {"nation": tables.empty_table(spark, "nation")}) is False
    assert tables.read_table(spark, root, "nation").count() == 2


def test_seed_keeps_rows_of_others_and_takes_up_its_own(spark, world, tmp_path):
    root = str(tmp_path / "half")
    tables.write_table(world["roster"], root, "roster")
    with pytest.raises(ValueError, match="roster"):
        tables.seed(spark, root, world)
    assert rows(tables.read_table(spark, root, "roster")) == rows(world["roster"])
    assert not (tmp_path / "half" / "unit").exists()

    # A load that stopped between two tables.
    broken = str(tmp_path / "broken")
    tables._mark_load(spark, broken, True)
    tables.write_table(world["unit"].limit(1), broken, "unit")
    assert tables.seed(spark, broken, world) is True
    assert rows(tables.read_table(spark, broken, "unit")) == rows(world["unit"])
    # Once done, emptied nations do not make it an open load again.
    tables.write_table(world["nation"].limit(0), broken, "nation", mode="overwrite")
    with pytest.raises(ValueError, match="unit"):
        tables.seed(spark, broken, world)


def test_faulty_text_rows_stop_the_read(spark, tmp_path):
    path = tmp_path / "nation.csv"
    path.write_text("nation_id,name,flag_path\nx7,a,\n", encoding="utf-8")
    with pytest.raises(Exception, match="x7|MALFORMED"):
        tables.reference_source(spark, str(path), "nation", "csv", header="true").collect()
    lax = tables.reference_source(
        spark, str(path), "nation", "csv", header="true", mode="PERMISSIVE"
    )
    assert rows(lax) == [(None, "a", None)]


def test_wide_rows_from_csv_are_split_for_a_first_load(spark, world, tmp_path):
    path = tmp_path / "units.csv"
    path.write_text(
        "unit_id,nation_id,category_id,name,tier,rating,cost,media_path,front,side,rear,"
        "munition_name,munition_kind,pen\n"
        "9,1,1,b,2,2.0,0,,1,2,3,shot,ap,40\n4,1,1,a,1,1.0,5,p.png,4,5,6,shell,,50\n",
        encoding="utf-8",
    )
    wide = tables.reference_source(spark, str(path), "staged_unit", "csv", header="true")
    parts = changes.split_seed(wide, "unit_id")
    root = str(tmp_path / "first")
    assert tables.seed(spark, root, {"nation": world["nation"]} | parts)
    stored = {name: rows(tables.read_table(spark, root, name)) for name in parts}
    assert stored["unit"] == [(4, 1, 1, "a", 1, 1.0, 5, "p.png"), (9, 1, 1, "b", 2, 2.0, 0, None)]
    assert stored["spec"] == [(4, 4, 5, 6), (9, 1, 2, 3)]
    assert stored["munition"] == [(1, 4, "shell", None, 50, True), (2, 9, "shot", "ap", 40, True)]


def test_reference_rows_from_csv(spark, tmp_path):
    path = tmp_path / "nation.csv"
    path.write_text("nation_id,name,flag_path\n1,독일,\n2,소련,x.png\n", encoding="utf-8")
    got = tables.reference_source(spark, str(path), "nation", "csv", header="true")
    assert rows(got) == [(1, "독일", None), (2, "소련", "x.png")]


def test_sorted_layout_narrows_the_files_of_a_search(spark, world, tmp_path):
    root = str(tmp_path / "laid")
    tables.write_table(world["unit"], root, "unit", cluster_by=("rating",))
    got = tables.read_table(spark, root, "unit")
    assert rows(got) == rows(world["unit"])
    per_file = (
        got.selectExpr("rating", "input_file_name() AS f").groupBy("f")
        .agg({"rating": "min"}).count()
    )
    assert per_file >= 1


def test_bucketed_tables_join_without_moving_rows(spark, world):
    tables.write_bucketed(world["roster"], "lab_roster", "roster_id", 4)
    tables.write_bucketed(world["slot"], "lab_slot", "roster_id", 4)
    joined = spark.table("lab_roster").join(
        spark.table("lab_slot").hint("merge"), "roster_id"
    )
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan
    assert joined.count() == 6
