"""Keyword search by the name index, against the scan."""

import re

import pytest
from pyspark.sql import functions as F

from rosterlab.functions import expressions as ex
from rosterlab.operators import names
from rosterlab.operators.names import NameIndex, indexed_unit_search, keyword_runs
from tests.conftest import rows

NAMES = [
    "Alpha", "alpine hut", "Pal", "a_b", "a%b", "back\\slash", "x\x01y", "", "é ÉTÉ", "日本語の名", "ab", "A", "zzz" * 9,
    "  ", "50% off_now", "aXbXc", "beta alpha beta", None,
]
KEYWORDS = [
    "alp", "ALPHA", "al%a", "a_b", "_", "%", "", "__", "lp", "a", "\\", "\x01", "k\\s", "été", "本語", "日本語の",
    "b%a%b", "zzzz", "zzzq", "%off%", "x_c", "nowhere", "alp%hut", "pha b_t", " ", "_____", "X", None,
]


@pytest.fixture
def units(make):
    return make("unit", [(i, 1, 1, n, 1, 1.0, 1, None) for i, n in enumerate([*NAMES, *NAMES[:4]])])


@pytest.mark.parametrize(("parts", "most"), [(1, 1), (8, 3)])
def test_hits_are_those_of_the_scan(spark, units, tmp_path, parts, most):
    index = NameIndex(str(tmp_path / "index"), parts=parts, most_runs=most)
    index.build(units)
    asked = spark.createDataFrame([(k,) for k in [*KEYWORDS, "alp"]], "keyword string")
    got = rows(index.search(asked), "keyword", "unit_id")
    want = []
    for keyword in filter(lambda k: k is not None, KEYWORDS):
        hits = units.where("name IS NOT NULL").where(ex.contains_ci(F.col("name"), keyword))
        want += [(keyword, r["unit_id"]) for r in hits.collect()]
    assert got == sorted(want, key=repr)


def test_runs_of_keywords(spark):
    table = spark.createDataFrame([("aBcd%e_fg",), ("%_",), ("ab",), ("ababab",)], "k string")
    got = [sorted(r[0]) for r in table.select(keyword_runs(F.col("k"))).collect()]
    assert got == [["abc", "bcd", "e", "fg"], [""], ["ab"], ["aba", "bab"]]


def test_a_search_reads_only_the_folders_it_needs(spark, units, tmp_path):
    index = NameIndex(str(tmp_path / "index"), parts=64)
    index.build(units)
    found = index.search(spark.createDataFrame([("alpine",)], "keyword string"))
    assert rows(found, "name") == [("alpine hut",), ("alpine hut",)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "name" in line]
    # Two units: the folders of their ids, of 64.
    asked = [re.search(r"PartitionFilters: \[[^]]*part#\d+ (?:IN \(([^)]*)\)|= (\d+))", line) for line in scans]
    assert scans and all(found and len((found[1] or found[2]).split(",")) <= 2 for found in asked)


def test_search_rows_by_keyword(spark, world, tmp_path):
    index = NameIndex(str(tmp_path / "index"))
    index.build(world["unit"])
    from rosterlab.operators import catalog

    every = catalog.unit_search(world["unit"], world["nation"], world["category"], sort=False)
    asked = spark.createDataFrame([("A",), ("ta",)], "keyword string")
    got = rows(indexed_unit_search(index, asked, every), "keyword", "unit_id")
    want = [(k, u) for k in ("A", "ta") for u, n in rows(every, "unit_id", "name") if k.lower() in n.lower()]
    assert got == sorted(want, key=repr)
    assert index.search(asked.limit(0)).count() == 0


def test_tasks_follow_the_rows_that_are_made(spark, units, tmp_path, monkeypatch):
    """Names in one small partition become many rows, which neither files nor shuffled bytes tell."""
    monkeypatch.setattr(names, "ROWS_PER_TASK", 40)
    index = NameIndex(str(tmp_path / "index"), parts=1)
    made = sum(1 + 3 * len(n) for n in [*NAMES, *NAMES[:4]] if n is not None)
    assert index.named(units.coalesce(1)).rdd.getNumPartitions() == -(-made // 40)
    index.build(units.coalesce(1))
    stored = spark.read.parquet(str(tmp_path / "index" / "postings"))
    sizes = stored.groupBy(F.input_file_name()).count().select("count").collect()
    assert max(r["count"] for r in sizes) <= 40
    plans, freeze = [], names.freeze
    monkeypatch.setattr(
        names, "freeze", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or freeze(df)
    )
    index.search(spark.createDataFrame([("%",), ("_",), ("alp",), ("a",)], "keyword string")).count()
    hits = 2 * stored.where("run = ''").count() + stored.where("run IN ('alp', 'a')").count()
    dealt = re.search(r"hashpartitioning\(keyword#\d+, unit_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plans[-1])
    assert int(dealt[1]) == -(-hits // 40)
