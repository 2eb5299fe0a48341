import random
from datetime import datetime, timedelta

import pytest

from rosterlab.operators.replay import apply_slot_changes
from rosterlab.streaming.feed import SlotFeed
from tests.conftest import rows

START = datetime(2024, 1, 1)
CHANGE = "change_id long, change_ts timestamp_ntz, roster_id long, slot_no int, unit_id long"
SLOT = ("roster_id", "slot_no", "unit_id", "role_note")


def changes_in_order(count, seed=3):
    rng = random.Random(seed)
    return [
        (i, START + timedelta(minutes=i), rng.choice((1, 1, 2, 3, 4, 9)), rng.randrange(0, 12),
         rng.randrange(1, 11))
        for i in range(count)
    ]


def tables(world):
    return world["roster"], world["unit"], world["nation"], world["category"]


@pytest.fixture
def open_feed(world, tmp_path):
    def build(name):
        return SlotFeed(str(tmp_path / name), *tables(world), buckets=4)

    return build


@pytest.fixture
def run(spark, world, tmp_path, open_feed):
    """run(parts) feeds each list of changes as one file and one micro-batch."""
    inbox, feed = tmp_path / "inbox", open_feed("target")
    feed.start(world["slot"])

    def go(*parts):
        for part in parts:
            spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = (
            spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(inbox))
        )
        feed.run(stream, str(tmp_path / "progress")).awaitTermination()
        return feed

    return go


def test_many_batches_equal_one_batch(spark, world, run):
    changes = changes_in_order(60)
    run(changes[:25])
    feed = run(changes[25:40], changes[40:])  # the feed goes on where it stopped
    at_once = apply_slot_changes(
        world["slot"], spark.createDataFrame(changes, CHANGE), *tables(world)
    )
    assert rows(feed.slots(), *SLOT) == rows(at_once.slots, *SLOT)
    outcome = dict(rows(feed.log(), "change_id", "verdict"))
    assert outcome == dict(rows(at_once.log, "change_id", "verdict"))


def test_repeats_are_dropped_and_older_changes_are_stale(run):
    late = (3, START - timedelta(days=900), 1, 3, 4)
    feed = run(
        [(1, START, 1, 3, 4), (1, START, 1, 3, 4)],
        [(1, START, 1, 3, 4), (2, START - timedelta(minutes=1), 1, 3, 2)],
        [late],
    )
    # However late a change is, it is logged.
    assert rows(feed.log(), "change_id", "verdict") == [(1, "add"), (2, "stale"), (3, "stale")]


def test_compacting_keeps_slots_and_stamps(spark, run, open_feed):
    feed, moved = run([(1, START, 1, 3, 4)]), open_feed("compacted")
    feed.compact(moved)
    assert rows(moved.slots()) == rows(feed.slots())
    moved.apply_batch(spark.createDataFrame([(2, START - timedelta(1), 1, 3, 2)], CHANGE), 0)
    assert rows(moved.log(), "change_id", "verdict") == [(2, "stale")]


def test_only_touched_rosters_are_written(spark, world, open_feed):
    feed = open_feed("narrow")
    feed.start(world["slot"])
    feed.apply_batch(
        spark.createDataFrame([(1, START, 4, 5, 5), (2, START, 77, 1, 1)], CHANGE), 0
    )
    written = spark.read.parquet(f"{feed.target}/slots/version=1")
    assert rows(written, "roster_id", "slot_no") == [(4, 3), (4, 5)]
    assert feed.slots().count() == 7


def test_a_batch_run_again_gives_the_same_version(spark, world, open_feed):
    feed = open_feed("again")
    feed.start(world["slot"])
    batch = spark.createDataFrame(changes_in_order(30), CHANGE)
    feed.apply_batch(batch, 0)
    before = rows(feed.slots()), rows(feed.log())
    feed.apply_batch(batch, 0)
    assert (rows(feed.slots()), rows(feed.log())) == before


def test_a_refused_change_delivered_again_stays_refused(spark, world, open_feed):
    feed = open_feed("refused")
    feed.start(world["slot"])
    first = (1, START, 1, 7, 1)  # unit 1 sits in slot 1
    freeing = (2, START + timedelta(minutes=1), 1, 1, 4)
    feed.apply_batch(spark.createDataFrame([first, freeing], CHANGE), 0)
    slots, log = rows(feed.slots()), rows(feed.log(), "change_id", "verdict")
    assert log == [(1, "already_placed"), (2, "replace")]
    # No repeat window is at work here: the log alone has to tell.
    feed.apply_batch(spark.createDataFrame([first, first], CHANGE), 1)
    assert (rows(feed.slots()), rows(feed.log(), "change_id", "verdict")) == (slots, log)
    moved = open_feed("refused-compacted")
    feed.compact(moved)
    moved.apply_batch(spark.createDataFrame([first], CHANGE), 0)
    assert rows(moved.slots()) == slots
