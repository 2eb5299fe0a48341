from pyspark.sql import functions as F

from rosterlab import schemas
from rosterlab.operators import intake, quality
from tests.conftest import rows


def test_clean_tables_have_no_violation(world):
    tables = {k: v for k, v in world.items()} | {"unit": world["unit"].where("unit_id <> 9")}
    for audit in (quality.audit_unique, quality.audit_not_null, quality.audit_check, quality.audit_fk):
        assert audit(tables).where("violations <> 0").isEmpty()
    assert quality.audit_unique(tables).count() == len(schemas.KEYS)
    assert quality.audit_fk(tables).count() == len(schemas.REFERENCES)


def test_shared_keys_and_null_keys(make):
    slots = make(
        "slot",
        [(1, 1, 1, None), (1, 2, 1, None), (1, 1, 3, None), (2, None, 1, None), (2, None, 2, None)],
    )
    found = rows(quality.audit_unique({"slot": slots}))
    assert found == [("slot", "roster_id,slot_no", 1, 2), ("slot", "roster_id,unit_id", 1, 2)]
    assert rows(quality.audit_unique_keys({"slot": slots}), "key_value", "row_count") == [("1|1", 2)] * 2


def test_null_breaks_not_null_but_no_check(make):
    units = make(
        "unit",
        [(1, 1, 1, "a", None, None, None, None), (2, 1, 1, None, 9, 0.5, -1, None)],
    )
    nulls = dict(rows(quality.audit_not_null({"unit": units}), "rule", "violations"))
    assert nulls == {
        "unit_id": 0, "nation_id": 0, "category_id": 0, "name": 1, "tier": 1, "rating": 1, "cost": 1,
    }
    broken = dict(rows(quality.audit_check({"unit": units}), "rule", "violations"))
    assert broken == {"tier_range": 1, "rating_low": 1, "cost_negative": 1}


def test_dangling_references_are_counted_by_value_and_row(world, make):
    slots = make("slot", [(1, 77, 1, None), (2, 77, 1, None), (99, 1, 1, None), (1, None, 2, None)])
    found = rows(quality.audit_fk({**world, "slot": slots}).where("table_name = 'slot'"))
    assert found == [("slot", "roster_id", 1, 1), ("slot", "unit_id", 1, 2)]


def test_intake_names_every_bad_field(spark):
    raw = spark.createDataFrame(
        [
            (1, " ok ", "1", "5.7"),
            (2, "\t", "", "x"),
            (3, None, "7.5", None),
        ],
        "line int, name string, tier string, rating string",
    )
    checked = intake.intake_validate(raw, texts=["name"], ints=["tier"], floats=["rating"])
    good, bad = intake.split_intake(checked)
    assert rows(good) == [(1, "ok", 1, 5.7)]
    assert rows(bad.select("line", F.concat_ws(" ", "reasons"))) == [
        (2, "name:required tier:required rating:malformed"),
        (3, "name:required tier:malformed rating:required"),
    ]


def test_intake_strips_and_reads_each_field_once(spark):
    raw = spark.createDataFrame([(1, " a ", " 1 ", "2.5")], "line int, name string, tier string, rating string")
    checked = intake.intake_validate(raw, texts=["name"], ints=["tier"], floats=["rating"])
    assert rows(checked, "name", "tier", "rating") == [("a", 1, 2.5)]
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 3 and plan.count("RLIKE") == 2
