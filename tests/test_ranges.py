"""Syncs over ranges of the key against the whole sync."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlab.operators.ranges import RangeStore, differing, digests, laid_out
from rosterlab.operators.sync import UnitSync
from tests.conftest import rows

PROVIDED = (
    "position long, preferred_id long, nation_id int, name string, category_id int, tier int, rating double, "
    "cost int, media_path string, front int, side int, rear int, munition_name string, munition_kind string, pen int"
)
N = 16


def offer(position, nation, name, preferred=None, path="x.png", rating=3.0, pen=5):
    return (position, preferred, nation, name, 1, 2, rating, 10, path, 1, 2, 3, f"shot {name}", "AP", pen)


@pytest.fixture
def tables(make):
    units = [(i, i % 2 + 1, 1, f"unit {i}", 1, 2.0, 5, None if i % 3 else "set.png") for i in range(1, 60)]
    return {
        "unit": make("unit", units),
        "spec": make("spec", [(i, 1, 1, 1) for i in range(1, 60, 2)] + [(999, 7, 7, 7)]),
        "munition": make("munition", [(i, i, "m", "AP", 3, i % 4 > 0) for i in range(1, 50)]),
        "nation": make("nation", [(1, "a", None), (2, "b", None)]),
        "category": make("category", [(1, "c", None)]),
    }


@pytest.fixture
def store(spark, tables, tmp_path):
    found = RangeStore(
        spark, str(tmp_path / "store"), {n: tables[n].schema for n in ("unit", "spec", "munition")}, ranges=N
    )
    found.load(tables["unit"], tables["spec"], tables["munition"])
    return found


def content(units, specs, munitions):
    """Rows by the unit's nation and name: ids may be given in another order."""
    named = units.select("unit_id", "nation_id", "name")
    shown = [units.drop("unit_id"), specs.join(named, "unit_id", "left").drop("unit_id")]
    shots = munitions.withColumnRenamed("name", "shot").join(named, "unit_id", "left")
    return [rows(t) for t in (*shown, shots.drop("unit_id", "munition_id"))]


def test_syncs_read_only_what_differs(spark, tables, store):
    rng = random.Random(1)
    first = [offer(i, i % 2 + 1, f"unit {i}", preferred=i + 7) for i in range(30, 90)]
    provided = spark.createDataFrame(first, PROVIDED)
    now = {n: tables[n] for n in ("unit", "spec", "munition")}
    changed = list(first)
    for step in range(4):
        provided = spark.createDataFrame(changed, PROVIDED)
        result = store.sync(laid_out(provided, N), tables["nation"], tables["category"])
        whole = UnitSync(
            now["unit"], now["spec"], now["munition"], provided, tables["nation"], tables["category"]
        )
        now = {"unit": whole.unit, "spec": whole.spec, "munition": whole.munition}
        got = {n: store.table(n) for n in now}
        assert content(*(got[n] for n in ("unit", "spec", "munition"))) == content(*now.values())
        ids = [r[0] for r in rows(got["unit"], "unit_id")]
        assert len(ids) == len(set(ids))
        now = got
        if step == 0:
            assert len(result.ranges) == N
        elif step == 1:
            assert result.ranges == []
        else:
            assert 0 < len(result.ranges) <= 4
        if step:
            changed = [*changed, offer(100 + step, 1, f"late {step}", preferred=2), offer(200 + step, 1, "late 1", path="")]
            changed[rng.randrange(30)] = offer(300 + step, 2, None)


def test_a_new_nation_reads_everything_again(spark, make, tables, store):
    provided = laid_out(spark.createDataFrame([offer(1, 3, "of nation three"), offer(2, 1, "new")], PROVIDED), N)
    result = store.sync(provided, tables["nation"], tables["category"])
    assert rows(result.rejected, "name") == [("of nation three",)]
    assert store.sync(provided, tables["nation"], tables["category"]).ranges == []
    nations = tables["nation"].union(make("nation", [(3, "c", None)]))
    assert store.sync(provided, nations, tables["category"]).ranges == list(range(N))
    assert ("of nation three",) in rows(store.table("unit"), "name")
    again = RangeStore(spark, store.root, store.schemas, ranges=N)  # another session finds the state
    assert again.sync(provided, nations, tables["category"]).ranges == []


def test_digests_are_of_rows_in_any_order(spark):
    table = spark.createDataFrame([(i, i % 5, None if i % 7 else "x") for i in range(300)], "id int, v int, t string")
    ranged = table.withColumn("range", F.col("id") % 200)
    other = ranged.withColumn("v", F.when(F.col("id").isin(3, 150), -1).otherwise(F.col("v")))
    assert differing(digests(ranged), digests(ranged.orderBy(F.rand(3)))) == []
    assert differing(digests(ranged), digests(other)) == [3, 150]
    assert differing(digests(ranged), digests(ranged.where("range <> 77"))) == [77]
    twice = ranged.union(ranged.where("id = 250"))
    assert differing(digests(ranged), digests(twice)) == [50]
