"""Every registered query against its SQL, at the smallest scale, and what its plan avoids."""

import pytest

import __spark_entry__ as entry
from workload import oracle, queries
from workload.check import compare, duckdb_over

SMALL = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"unit_search"}
# Walking ordered changes and writing bitmaps out are the steps that run in Python.
PYTHON_STEPS = {
    "available_bitmaps",
    "apply_slot_changes",
    "apply_slot_changes_log",
    "apply_mixed_changes",
    "apply_mixed_changes_log",
}


@pytest.fixture(scope="module")
def connection():
    return duckdb_over(SMALL)


def test_every_query_has_sql():
    assert set(oracle.statements()) == set(queries.registered())
    assert set(queries.registered()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_same_rows(spark, connection, name):
    got = queries.registered()[name](spark, SMALL)
    fault = compare(got, connection, oracle.statements()[name])
    assert fault in ({"", "both empty"} if name in MAY_BE_EMPTY else {""})
    plan = got._jdf.queryExecution().executedPlan().toString()
    avoided = {"CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"}
    if name in PYTHON_STEPS:
        avoided -= {"Python", "Arrow"}
    assert not [node for node in avoided if node in plan]


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
