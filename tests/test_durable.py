"""Stored rows and their folders."""

import os

import pytest

from rosterlab.plans.durable import freeze, freeze_counted, new_folder, scratch


def files(spark):
    root = new_folder(spark, "x").rsplit("/", 1)[0]
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_scratch_deletes_what_was_stored_inside(spark):
    outside = freeze(spark.range(3))
    before = files(spark)
    with scratch(spark):
        with scratch(spark):
            inner = freeze(spark.range(5))
            assert inner.count() == 5 and len(files(spark)) == len(before) + 1
        assert files(spark) == before
        freeze(spark.range(7))
        new_folder(spark, "never-written")
    assert files(spark) == before and outside.count() == 3


def test_scratch_deletes_after_an_error(spark):
    before = files(spark)
    with pytest.raises(KeyError), scratch(spark):
        freeze(spark.range(5))
        raise KeyError
    assert files(spark) == before


def test_rows_are_counted_while_they_are_stored(spark):
    rows, n = freeze_counted(spark.range(1000).where("id % 7 = 0"))
    assert n == rows.count() == 143
    assert freeze_counted(spark.range(0))[1] == 0
