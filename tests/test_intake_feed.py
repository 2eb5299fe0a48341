"""Registration as a stream, against one registration of everything."""

import random

import pytest

from rosterlab.operators import changes
from rosterlab.operators.changes import register_units
from rosterlab.operators.intake import intake_validate, split_intake
from rosterlab.plans.numbering import highest
from rosterlab.streaming import intake_feed
from rosterlab.streaming.intake_feed import ACCEPTED, QUARANTINE, REJECTED, IntakeFeed
from tests.conftest import rows

FIELDS = (
    "request_id long, nation_id int, category_id int, name string, tier int, rating double, cost int, "
    "media_path string, front int, side int, rear int, munition_name string, munition_kind string, pen int"
)


def requests(count):
    rng = random.Random(8)
    out = []
    for i in range(count):
        row = [i, rng.choice("1123"), rng.choice("123"), f" Name {rng.randrange(40)} ", "2", "3.5", "10", "p", "1", "2", "3",
               "shot", "AP", "7"]
        if i % 9 == 4:
            row[rng.choice((3, 4, 5, 8))] = rng.choice(["", "x1", None])
        out.append(tuple(row))
    return out


@pytest.fixture
def feed(spark, world, tmp_path):
    fields = spark.createDataFrame([], FIELDS).schema
    found = IntakeFeed(
        str(tmp_path / "out"), world["unit"], world["munition"], world["nation"], world["category"], fields
    )
    found.start()
    return found


def raw(spark, given):
    names = [c.split()[0] for c in FIELDS.split(", ")]
    return spark.createDataFrame(given, ", ".join(["request_id long", *[f"{c} string" for c in names[1:]]]))


def at_once(spark, world, given):
    good, bad = split_intake(intake_validate(raw(spark, given)))
    typed = good.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in FIELDS.split(", ")])
    return register_units(typed, world["unit"], world["munition"], world["nation"], world["category"]), bad


def test_many_batches_equal_one(spark, world, feed, tmp_path):
    given = requests(90)
    result, bad = at_once(spark, world, given)
    inbox = str(tmp_path / "inbox")
    for part in (given[:40], given[40:41], [*given[:20], *given[41:], *given[60:]], given):
        raw(spark, part).repartition(2).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(raw(spark, given[:1]).schema).parquet(inbox)
        feed.run(stream, str(tmp_path / "progress")).awaitTermination()
    columns = result.accepted.columns
    assert rows(feed.table(ACCEPTED), *columns) == rows(result.accepted, *columns)
    assert rows(feed.table(REJECTED), "request_id") == rows(result.rejected, "request_id")
    assert rows(feed.table(QUARANTINE), "request_id", "reasons") == rows(bad, "request_id", "reasons")
    total = sum(feed.table(kind).count() for kind in (ACCEPTED, REJECTED, QUARANTINE))
    assert total == len(given) and feed.table(QUARANTINE).count() > 3
    assert feed.registered().count() == world["unit"].count() + feed.table(ACCEPTED).count()


def test_a_batch_run_again_gives_the_same_ids(spark, feed):
    given = requests(30)
    feed.apply_batch(raw(spark, given[:15]), 0)
    feed.apply_batch(raw(spark, given[15:]), 1)
    before = rows(feed.table(ACCEPTED)), rows(feed.table(QUARANTINE))
    feed.apply_batch(raw(spark, given[15:]), 1)
    assert (rows(feed.table(ACCEPTED)), rows(feed.table(QUARANTINE))) == before


def test_ids_before_the_feed_are_looked_for_once(spark, feed, monkeypatch):
    """Whatever the stored munitions are made of, the feed does not make them again for every batch."""
    asked = []
    for module in (changes, intake_feed):
        monkeypatch.setattr(module, "highest", lambda df, column: asked.append(column) or highest(df, column))
    given = requests(30)
    feed.apply_batch(raw(spark, given[:15]), 0)
    feed.apply_batch(raw(spark, given[15:]), 1)
    assert sorted(asked) == ["munition_id", "unit_id"]
    ids = rows(feed.table(ACCEPTED), "unit_id", "munition_id")
    assert ids == [(10 + i, 10 + i) for i in range(len(ids))] and len(ids) > 15
