"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rosterlab.operators import benchmark, catalog, changes, roster
from rosterlab.sources import tables
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Set SQL settings for one test."""
    changed = {}

    def put(**values):
        for key, value in values.items():
            name = "spark.sql." + key.replace("__", ".")
            changed.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, old in changed.items():
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def test_search_filters_and_columns_reach_the_files(spark, world, tmp_path, settings):
    settings(maxMetadataStringLength="10000")
    root = str(tmp_path / "t")
    tables.write_table(world["unit"], root, "unit")
    units = tables.read_table(spark, root, "unit")
    found = catalog.unit_search(
        units, world["nation"], world["category"], nation_id=1, rating_min=2.0, rating_max=5.0,
        sort=False,
    ).select("unit_id", "nation")
    plan = plan_of(found)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    for part in ("EqualTo(nation_id,1)", "GreaterThanOrEqual(rating,2.0)",
                 "LessThanOrEqual(rating,5.0)"):
        assert part in pushed
    assert "media_path" not in re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)


def test_one_roster_is_a_filter_that_reaches_the_slot_files(spark, world, tmp_path, settings):
    settings(maxMetadataStringLength="10000")
    root = str(tmp_path / "t")
    for name in ("roster", "slot"):
        tables.write_table(world[name], root, name)
    rosters, slots = (tables.read_table(spark, root, name) for name in ("roster", "slot"))
    for result in (
        roster.roster_summary(rosters, world["nation"], slots, world["unit"]),
        roster.roster_detail(
            rosters, world["nation"], slots, world["unit"], world["category"], sort=False
        ),
        roster.slot_grid(rosters, world["nation"], slots, world["unit"], world["category"]),
    ):
        plan = plan_of(result.where("roster_id = 1"))
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert len(scans) == 2
        assert all("EqualTo(roster_id,1)" in scan for scan in scans)


def test_slots_are_added_up_before_they_meet_the_rosters(world):
    plan = plan_of(
        roster.roster_summary(world["roster"], world["nation"], world["slot"], world["unit"])
    )
    assert "partial_count" in plan


def test_benchmark_works_out_caps_once(spark):
    """Bands and rows read the stored caps: the plan that makes the rows adds up no slots."""
    plan = plan_of(entry.queries()["peer_benchmark"](spark, SMALL))
    assert "max(rating" not in plan
    assert plan.count("frozen") >= 2


@pytest.fixture
def skewed(spark, settings):
    """One unit and one roster each hold a third of the slots; no side may be broadcast."""
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="16KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="32KB",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
    )
    n = 60_000
    slots = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 4999 + 2).alias("roster_id"),
        F.when(F.col("id") % 3 == 1, 1).otherwise(F.xxhash64("id") % 2000 + 2001).alias("unit_id"),
        (F.col("id") % 10 + 1).cast("int").alias("slot_no"),
        F.lit("note").alias("role_note"),
    )
    units = spark.range(1, 4002).select(
        F.col("id").alias("unit_id"), F.lit(1).alias("nation_id"), F.lit(1).alias("category_id"),
        F.concat(F.lit("u"), "id").alias("name"), F.lit(1).alias("tier"),
        (F.col("id") % 90 / 10 + 1).alias("rating"), F.lit(2).alias("cost"),
        F.lit(None).cast("string").alias("media_path"),
    )
    rosters = spark.range(1, 5002).select(
        F.col("id").alias("roster_id"), F.lit(1).alias("nation_id"), F.lit("t").alias("title"),
        F.lit("Arcade").alias("game_mode"), F.lit(1.0).alias("target_rating"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )
    return slots, units, rosters, n


def test_hot_unit_is_split_in_the_summary(world, skewed):
    slots, units, rosters, n = skewed
    summary = roster.roster_summary(rosters, world["nation"], slots, units)
    got = summary.agg(F.sum("unit_count").alias("n"), F.max("unit_count").alias("top"))
    assert [tuple(r) for r in got.collect()] == [(n, n // 3)]
    assert "skew=true" in plan_of(got)


def test_hot_roster_is_split_in_the_detail(world, skewed):
    slots, units, rosters, n = skewed
    detail = roster.roster_detail(
        rosters, world["nation"], slots, units, world["category"], sort=False
    )
    assert len(detail.collect()) == n
    assert plan_of(detail).count("skew=true") >= 2


def test_hot_keys_keep_verdicts_and_benchmark_whole(spark, world, skewed):
    slots, units, rosters, n = skewed
    asked = slots.select(
        F.monotonically_increasing_id().alias("change_id"), "roster_id", "slot_no", "unit_id"
    )
    got = changes.slot_change_verdicts(
        asked, slots, rosters, units, world["nation"], world["category"]
    )
    assert len(got.collect()) == n
    assert "skew=true" in plan_of(got)
    specs = units.select(
        "unit_id", F.lit(1).alias("front"), F.lit(1).alias("side"), F.lit(1).alias("rear")
    )
    shots = units.select(
        F.col("unit_id").alias("munition_id"), "unit_id", "name", F.lit("k").alias("kind"),
        F.lit(5).alias("pen"), F.lit(True).alias("is_representative"),
    )
    wide = benchmark.peer_benchmark(slots, slots, units, specs, shots)
    assert len(wide.collect()) == n
    assert "skew=true" in plan_of(wide)


def test_hot_name_in_a_registration(spark, world, skewed):
    batch = spark.range(30_000).select(
        F.col("id").alias("request_id"), F.lit(1).alias("nation_id"),
        F.lit(1).alias("category_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), "id")).alias("name"),
        F.lit(1).alias("tier"), F.lit(2.0).alias("rating"), F.lit(1).alias("cost"),
        F.lit("").alias("media_path"), F.lit(1).alias("front"), F.lit(1).alias("side"),
        F.lit(1).alias("rear"), F.lit("m").alias("munition_name"),
        F.lit("").alias("munition_kind"), F.lit(1).alias("pen"),
    )
    done = changes.register_units(
        batch, world["unit"], world["munition"], world["nation"], world["category"]
    )
    assert done.accepted.count() == 20_001
    assert rows(done.rejected.groupBy("reason").count()) == [("name_taken_in_batch", 9_999)]


def test_rosters_are_not_shuffled_by_cap(spark):
    """The number of caps is known when the join with all rosters is planned."""
    for name in ("peer_benchmark", "peer_benchmark_long"):
        plan = plan_of(entry.queries()[name](spark, SMALL))
        assert not re.search(r"hashpartitioning\(cap_all", plan), plan
