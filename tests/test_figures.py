"""Figures that follow the moves, against figures worked out from the slots."""

import random
from datetime import timedelta

import pytest

from rosterlab.operators import roster
from rosterlab.operators.figures import FigureLog, tally
from rosterlab.streaming.live import LiveSlots
from tests.conftest import rows
from tests.test_mixed import CHANGE, START

SUMMARY = ("roster_id", "unit_count", "average_rating", "cap_same_nation", "total_cost")


@pytest.fixture
def tables(make):
    units = [
        (u, u % 2 + 1, u % 3 + 1, f"u{u}", 1, None if u == 8 else u % 5 + 0.5, None if u in (6, 8) else 100 * u, None)
        for u in range(1, 16)
    ]
    return {
        "unit": make("unit", units),
        "nation": make("nation", [(1, "a", None), (2, "b", None)]),
        "category": make("category", [(1, "c", None), (2, "d", None)]),
        "roster": make("roster", [(r, r % 2 + 1, "t", "Arcade", 1.0, START) for r in range(1, 9)]),
    }


def same(figures, slots, t):
    summary = roster.roster_summary(t["roster"], t["nation"], slots, t["unit"])
    assert rows(figures.summary(t["roster"], t["nation"]), *SUMMARY) == rows(summary, *SUMMARY)
    counts = roster.category_counts(t["roster"], slots, t["unit"], t["category"], sort=False)
    columns = ("roster_id", "category", "unit_count")
    assert rows(figures.category_counts(t["roster"], t["category"]), *columns) == rows(counts, *columns)


def test_figures_after_each_batch(spark, make, tables, tmp_path):
    """The highest unit leaves, units come back, slots hold a unit twice, batches come again."""
    rng = random.Random(2)
    slots = [(r, u, s, "") for r in range(1, 6) for s, u in ((1, r), (2, r + 2), (2, r + 2), (3, r + 8), (9, 77))]
    slots += [(7, None, 4, ""), (7, 8, 5, "")]
    start = make("slot", slots)
    figures = FigureLog(str(tmp_path / "figures"), tables["unit"])
    figures.start(start)
    kept = LiveSlots(
        str(tmp_path / "live"), start, tables["roster"], tables["unit"], tables["nation"], tables["category"]
    )
    same(figures, start, tables)
    inbox, number = str(tmp_path / "inbox"), 0
    for count in (60, 1, 80):
        batch = []
        for _ in range(count):
            number += 1
            kind = rng.choices(["place", "remove_unit", "remove_slot"], [6, 2, 1])[0]
            moment = START + timedelta(minutes=number)
            batch.append((number, moment, rng.choice((1, 1, 2, 3, 7, 8)), rng.randrange(1, 11), rng.randrange(1, 16), kind))
        spark.createDataFrame(batch, CHANGE).write.mode("append").parquet(inbox)
        kept.run(spark.readStream.schema(CHANGE).parquet(inbox), figures).awaitTermination()
        same(figures, kept.slots(), tables)
    # The last batch's version written again, as after a failure.
    figures.add(kept.moves().where("version = 2"), 3)
    same(figures, kept.slots(), tables)
    folded = FigureLog(str(tmp_path / "folded"), tables["unit"])
    figures.compact(folded)
    same(folded, kept.slots(), tables)


def test_a_batch_writes_only_its_rosters(spark, make, tables, tmp_path):
    figures = FigureLog(str(tmp_path / "figures"), tables["unit"])
    figures.start(make("slot", [(r, r, 1, "") for r in range(1, 8)]))
    moves = [(3, 3, -1), (3, 5, 1), (4, 99, 1), (5, 7, 1), (5, 7, -1)]
    figures.add(spark.createDataFrame(moves, "roster_id long, unit_id long, weight int"), 1)
    written = spark.read.parquet(f"{figures.target}/version=1")
    assert rows(written, "roster_id", "units") == [(3, -1), (3, 1)]
    plan = figures.tallies().where("roster_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(roster_id,3)" in plan


def test_each_row_of_the_log_is_dealt_out_once(spark, make, tables, tmp_path):
    """Tallies, figures and the join with the rosters share one shuffle by roster and nation."""
    figures = FigureLog(str(tmp_path / "figures"), tables["unit"])
    slots = make("slot", [(r, r, 1, "") for r in range(1, 8)])
    figures.start(slots)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moves = slots.selectExpr("roster_id", "unit_id", "1 AS weight")
        plans = [
            found._jdf.queryExecution().executedPlan().toString().splitlines()
            for found in (figures.tallies(), figures.summary(tables["roster"], tables["nation"]), tally(moves, tables["unit"]))
        ]
        same(figures, slots, tables)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64MB")
    tallies, summary, start = ([line for line in plan if "Exchange hashpartitioning(" in line] for plan in plans)
    assert len(tallies) == 1 and not any("rating" in line for line in tallies + summary)
    # A side each of the joins with nations and with rosters; the log is one of them.
    assert len(summary) == 4
    # By unit on both sides, then by what is added up.
    assert len(start) == 3
