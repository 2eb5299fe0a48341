"""Settings that bound what the driver broadcasts and what a task holds."""

import re

import pytest

from rosterlab.plans.durable import freeze
from rosterlab.session import INITIAL, sized_by_input, tune
from workload.queries import registered


@pytest.fixture
def apart(spark):
    """A session of its own, so that its settings do not outlive the test."""
    return spark.newSession()


def test_stored_rows_that_pack_well_are_not_broadcast(apart):
    """A few megabytes of Parquet that are a hundred as rows."""
    stored = freeze(tune(apart).range(6_000_000).selectExpr("id", "id % 7 AS kind"))
    few = apart.range(6_000_000, numPartitions=4).where("id % 3 = 0")
    joined = few.join(stored, "id", "left")
    assert joined.where("kind IS NOT NULL").count() == 2_000_000
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_input_and_leave_the_callers_number(apart):
    apart.conf.set("spark.sql.shuffle.partitions", "4")
    sized_by_input(apart, 1 << 20)
    assert apart.conf.get(INITIAL) == "4"
    sized_by_input(apart, 1 << 30)
    assert apart.conf.get(INITIAL) == "128"
    sized_by_input(apart, 1 << 20)
    assert apart.conf.get(INITIAL) == "4"
    apart.conf.set(INITIAL, "9")
    sized_by_input(apart, 1 << 30)
    assert apart.conf.get(INITIAL) == "9"


def test_what_a_task_reads_is_bounded(apart):
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        apart.conf.unset(key)
        tune(apart)
        assert apart.conf.get(key) == "16MB"


@pytest.mark.parametrize(
    "name",
    ["audit_unique", "audit_unique_keys", "audit_not_null", "unit_munitions", "delete_units_munitions",
     "remove_slots_by_unit"],
)
def test_shuffles_of_a_query_start_with_partitions_by_its_input(apart, name):
    """What one task adds up or sorts follows from them; merging small ones has a bound of its own."""
    apart.conf.set("spark.sql.shuffle.partitions", "2")
    apart.conf.unset(INITIAL)
    found = registered()[name](apart, "/root/testdata/sf0.1")
    dealt = re.findall(r"(?:hash|range)partitioning\(.*?, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())
    # Twenty megabytes of files.
    assert dealt and set(dealt) == {"3"}
