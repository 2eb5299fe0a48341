"""Audits that follow change sets against audits of the whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlab import schemas
from rosterlab.operators import quality
from rosterlab.operators.audit_state import CHECK, REFERENCE, REQUIRED, UNIQUE, AuditLog, weighted
from tests.conftest import rows


def same(log, spark, tables):
    got = log.report(spark)

    def of(kind, *columns):
        return rows(got.where(F.col("kind") == kind), "table_name", "rule", *columns)

    two = ("violations", "rows_involved")
    assert of(UNIQUE, *two) == rows(quality.audit_unique(tables), "table_name", "rule", *two)
    assert of(REFERENCE, *two) == rows(quality.audit_fk(tables), "table_name", "rule", *two)
    assert of(REQUIRED, "violations") == rows(quality.audit_not_null(tables), "table_name", "rule", "violations")
    checks = quality.audit_check(tables, log.checks)
    assert of(CHECK, "violations") == rows(checks, "table_name", "rule", "violations")


@pytest.fixture
def log(tmp_path):
    return AuditLog(str(tmp_path / "audit"), checks=schemas.checks(), buckets=8)


def test_report_after_each_change_set(spark, world, make, log):
    """Rows come, go, come back and repeat; parents leave while rows name them."""
    rng = random.Random(3)
    now = {name: [tuple(r) for r in df.collect()] for name, df in world.items()}
    now["slot"] += [(1, 1, 1, "again"), (77, 1, 2, ""), (1, None, 3, ""), (2, 99, 11, "")]
    tables = {name: make(name, given) for name, given in now.items()}
    log.apply({name: weighted(came=df) for name, df in tables.items()}, 0)
    same(log, spark, tables)
    gone: dict[str, list] = {name: [] for name in now}
    for version in range(1, 5):
        changes = {}
        for name in rng.sample(sorted(now), 4):
            went = rng.sample(now[name], min(len(now[name]), rng.randrange(4)))
            came = rng.sample(gone[name], min(len(gone[name]), 2))
            came += [r for r in rng.sample(now[name], min(1, len(now[name]))) if r not in went]  # a repeated row
            for r in went:
                now[name].remove(r)
            gone[name] = [r for r in gone[name] if r not in came] + went
            now[name] += came
            changes[name] = weighted(make(name, came), make(name, went))
        log.apply(changes, version)
        same(log, spark, {name: make(name, given) for name, given in now.items()})
    log.apply(changes, version)  # once more, as after a failure
    same(log, spark, {name: make(name, given) for name, given in now.items()})


def test_a_change_set_reads_its_buckets_only(spark, make, world, tmp_path):
    log = AuditLog(str(tmp_path / "audit"), checks=schemas.checks(), buckets=64)
    log.apply({name: weighted(came=df) for name, df in world.items()}, 0)
    log.apply({"munition": weighted(came=make("munition", [(1, 1, "twice", "AP", -4, True)]))}, 1)
    written = spark.read.parquet(f"{log.target}/counts/version=1")
    assert rows(written, "kind", "rule") == [
        ("check", "pen_negative"), ("reference", "unit_id"), ("unique", "munition_id")
    ]
    moved = rows(spark.read.parquet(f"{log.target}/report/version=1"), "kind", "rule", "violations", "rows_involved")
    assert moved == [("check", "pen_negative", 1, 1), ("unique", "munition_id", 1, 2)]


def test_texts_in_keys_are_kept_apart(spark, make, tmp_path):
    log = AuditLog(str(tmp_path / "audit"))
    units = make("unit", [(1, 1, 1, 'a","b', 1, 1.0, 1, None), (2, 1, 1, "a|b", 1, 1.0, 1, None), (3, 1, 1, "a", 1, 1.0, 1, None)])
    log.apply({"unit": weighted(came=units)}, 0)
    assert log.report(spark).where("kind = 'unique' AND violations > 0").count() == 0


def test_rows_of_a_rule_are_shuffled_once(world, tmp_path):
    log = AuditLog(str(tmp_path / "audit"), references=(), required={})
    plan = log.tally({"slot": weighted(came=world["slot"])})._jdf.queryExecution().executedPlan().toString()
    keys = [k for k in log.keys if k.table == "slot"]
    assert len(keys) == 2 and plan.count("Exchange") == len(keys)
    # They meet by their key columns and become text afterwards.
    assert "to_json" not in "".join(line for line in plan.splitlines() if "Exchange" in line or "HashAggregate" in line)
