"""The provider data source."""

import json

import pytest

from rosterlab.sources import provider, tables
from tests.conftest import rows


class Numbers:
    """A provider of made rows: three parts of some units."""

    def __init__(self, first: str = "1") -> None:
        self.first = int(first)

    def parts(self, table):
        return [0, 10, 20] if table == "unit" else []

    def rows(self, table, part):
        for i in range(part + self.first, part + self.first + 3):
            yield {"unit_id": i, "nation_id": 1, "name": f"u{i}", "rating": i / 2, "other": "left out"}


@pytest.fixture
def read(spark):
    provider.register(spark)
    return lambda table, name, **options: provider.provided(spark, table, name, **options)


def test_parts_are_read_apart(read):
    found = read("unit", "tests.test_provider:Numbers", first="5")
    assert found.rdd.getNumPartitions() == 3
    assert rows(found, "unit_id") == [(i,) for i in (15, 16, 17, 25, 26, 27, 5, 6, 7)]
    assert found.where("unit_id = 16").first()["name"] == "u16" and found.first()["media_path"] is None
    assert read("spec", "tests.test_provider:Numbers").count() == 0


def test_line_files_seed_a_store(spark, read, world, tmp_path):
    for name in ("nation", "unit"):
        world[name].repartition(3).write.json(str(tmp_path / "given" / name))
    extra = tmp_path / "given" / "unit" / "more.json"
    extra.write_text(json.dumps({"unit_id": 77, "nation_id": 2, "name": "né"}) + "\n\n", encoding="utf-8")
    path = str(tmp_path / "given")
    given = {n: read(n, "rosterlab.sources.provider:LineFiles", path=path) for n in ("nation", "unit")}
    root = str(tmp_path / "store")
    assert tables.seed(spark, root, given) and not tables.seed(spark, root, given)
    stored = tables.read_table(spark, root, "unit")
    assert rows(stored.where("unit_id <> 77")) == rows(world["unit"])
    assert stored.where("unit_id = 77").first()["name"] == "né"


def test_values_that_do_not_fit_stop_the_read(read, tmp_path):
    (tmp_path / "unit").mkdir()
    (tmp_path / "unit" / "a.json").write_text('{"unit_id": "seven"}\n')
    found = read("unit", "rosterlab.sources.provider:LineFiles", path=str(tmp_path))
    with pytest.raises(Exception):  # noqa: B017
        found.collect()
