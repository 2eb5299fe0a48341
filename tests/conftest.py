import pytest

from rosterlab.schemas import TABLES
from rosterlab.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        name="tests",
        **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """make("unit", [(…), …]) → DataFrame with the declared schema."""

    def build(name, rows):
        return spark.createDataFrame(rows, TABLES[name])

    return build


def rows(df, *columns):
    """Rows as a sorted list of tuples, for order-free comparison."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


@pytest.fixture
def world(make):
    """A small clean catalogue: two nations, three categories, nine units, four rosters."""
    from datetime import datetime

    return {
        "nation": make("nation", [(1, "Germany", "a.png"), (2, "Elbonia", None)]),
        "category": make("category", [(1, "SPAA", None), (2, "Walker", "w"), (3, "Medium Tank", "")]),
        "unit": make(
            "unit",
            [
                (1, 1, 1, "Alpha", 3, 5.7, 3400, "a.png"),
                (2, 1, 2, "Beta", 3, 5.3, 3100, None),
                (3, 1, 3, "Gamma", 3, 4.0, 1600, "  "),
                (4, 1, 3, "delta", 2, 4.7, 100, "assets/vehicle_placeholder.svg"),
                (5, 2, 1, "Alpha", 5, 6.7, 200, "x/alpha.png"),
                (6, 2, 2, "Zeta_50%", 5, 6.8, 300, ""),
                (7, 2, 3, "Eta\\x", 8, 4.6, 400, None),
                (8, 2, 3, "Theta", 8, 1.0, 0, None),
                (9, 2, 9, "Orphan", 1, 5.0, 10, None),
            ],
        ),
        "spec": make(
            "spec",
            [(1, 100, 80, 80), (2, 80, 40, 40), (4, 75, 75, 70), (5, 40, 20, 15), (6, 1, 1, 1),
             (7, 2, 2, 2)],
        ),
        "munition": make(
            "munition",
            [
                (1, 1, "shot one", "AP", 145, True),
                (2, 2, "shot two", "AP", 149, True),
                (3, 4, "shot four", None, 86, True),
                (4, 4, "spare", "HE", 10, False),
                (5, 5, "b", "AP", 182, True),
                (6, 5, "a", "HE", 90, True),
                (7, 6, "z", "AP", 500, True),
                (8, 7, "only spare", "AP", 7, False),
                (9, 3, "no spec", "AP", 48, True),
            ],
        ),
        "roster": make(
            "roster",
            [
                (1, 1, "first", "Realistic", 5.7, datetime(2024, 1, 1)),
                (2, 1, "empty", "Arcade", 1.0, datetime(2024, 1, 2)),
                (3, 2, "foreign only", "Realistic", 1.0, datetime(2024, 1, 3)),
                (4, 2, "newest", "Simulator", 1.0, datetime(2024, 1, 3)),
            ],
        ),
        "slot": make(
            "slot",
            [
                (1, 1, 1, "lead"),
                (1, 2, 2, None),
                (1, 3, 10, "x"),
                (1, 5, 4, "of another nation"),
                (3, 1, 1, None),
                (4, 7, 3, "y"),
            ],
        ),
    }
