import random

import pytest
from pyspark.sql import functions as F

from rosterlab.functions import fixed_values as fv
from rosterlab.operators import benchmark
from rosterlab.plans.bands import band_points, band_totals
from tests.conftest import rows

# Ratings and metrics worked out by hand: rating, pen, front, side, rear. Twelve rows lie in
# 4.7 .. 6.7, with both ends taken exactly.
PEERS = [
    (5.3, 128, 63, 38, 38), (5.7, 128, 13, 13, 13), (5.7, 145, 100, 80, 80), (5.3, 149, 80, 40, 40),
    (4.7, 86, 75, 75, 70), (6.0, 170, 120, 90, 60), (4.7, 91, 152, 95, 50), (5.7, 125, 45, 45, 40),
    (5.0, 182, 63, 38, 38), (6.7, 182, 40, 20, 15), (5.7, 145, 55, 30, 20), (6.0, 400, 51, 38, 38),
    (4.3, 125, 50, 25, 20), (7.7, 250, 152, 51, 38), (4.0, 48, 80, 30, 20),
]


@pytest.fixture
def golden(make):
    ids = range(101, 101 + len(PEERS))
    return {
        "unit": make(
            "unit", [(i, 1, 1, f"u{i}", 1, p[0], 1, None) for i, p in zip(ids, PEERS, strict=True)]
        ),
        "spec": make("spec", [(i, *p[2:]) for i, p in zip(ids, PEERS, strict=True)]),
        "munition": make(
            "munition", [(i, i, "m", "k", p[1], True) for i, p in zip(ids, PEERS, strict=True)]
        ),
        "slot": make("slot", [(1, 103, 1, ""), (1, 104, 2, ""), (1, 115, 3, "")]),
    }


def wide(tables, pairs, **more):
    return benchmark.peer_benchmark(
        pairs, tables["slot"], tables["unit"], tables["spec"], tables["munition"], **more
    )


def test_golden_peers_and_verdicts(spark, golden):
    pairs = spark.createDataFrame([(1, 103)], "roster_id long, unit_id long")
    result = wide(golden, pairs)
    row = result.first()
    assert (row["cap_all"], row["band_low"], row["band_high"]) == (5.7, 4.7, 6.7)
    assert row["band_label"] == "4.7 ~ 6.7"
    assert row["peer_count"] == 12
    long = benchmark.peer_benchmark_long(result)
    got = {
        r["metric"]: (r["selected"], r["average"], r["gap_pct"], r["verdict"]) for r in long.collect()
    }
    v = fv.VERDICTS
    assert got == {
        "관통력": (145.0, 160.9, -9.9, v["slightly_low"]),
        "정면 장갑": (100.0, 71.4, 40.0, v["very_high"]),
        "측면 장갑": (80.0, 50.2, 59.5, v["very_high"]),
        "후면 장갑": (80.0, 41.8, 91.2, v["very_high"]),
    }
    assert rows(benchmark.metric_family(long, "penetration"), "metric") == [("관통력",)]
    assert benchmark.metric_family(long, "armor").count() == 3


def test_unit_needs_spec_and_munition_but_not_the_roster(spark, world):
    pairs = spark.createDataFrame(
        [(1, 1), (1, 3), (1, 7), (1, 8), (3, 6), (1, 5)], "roster_id long, unit_id long"
    )
    got = rows(wide(world, pairs), "roster_id", "unit_id", "munition_id")
    assert got == [(1, 1, 1), (1, 5, 5), (1, 5, 6), (3, 6, 7)]
    single = rows(wide(world, pairs, one_munition=True), "roster_id", "unit_id", "munition_id")
    assert single == [(1, 1, 1), (1, 5, 5), (3, 6, 7)]


def test_several_representatives_weigh_several_times(spark, world):
    pairs = spark.createDataFrame([(1, 1)], "roster_id long, unit_id long")
    row = wide(world, pairs).first()
    # Cap 6.7 → band 5.7 .. 7.7: unit 1, unit 5 twice, unit 6.
    assert row["peer_count"] == 4
    assert row["avg_pen"] == (145 + 182 + 90 + 500) / 4
    assert row["avg_front"] == (100 + 40 + 40 + 1) / 4


def test_roster_without_units_and_empty_peer_set(spark, world, make):
    pairs = spark.createDataFrame([(2, 1), (5, 1)], "roster_id long, unit_id long")
    slots = world["slot"].union(make("slot", [(5, 8, 1, None)]))
    result = wide({**world, "slot": slots}, pairs)
    assert rows(result, "roster_id", "cap_all", "peer_count", "avg_pen", "band_label") == [
        (2, None, 0, None, "-"), (5, 1.0, 0, None, "0.0 ~ 2.0"),
    ]
    long = benchmark.peer_benchmark_long(result)
    assert {(r["gap_pct"], r["verdict"]) for r in long.collect()} == {(0.0, fv.VERDICTS["similar"])}


@pytest.mark.parametrize(
    ("step", "half_width", "leaf"),
    [(0.1, 1.0, 1 << 18), (None, 1.0, 1 << 18), (None, 0.003, 64), (0.5, 7.5, 10), (None, 1.0, 100), (0.1, 0.0, 7)],
)
def test_band_totals_equal_brute_force(spark, step, half_width, leaf):
    rng = random.Random(5)

    def rating():
        return rng.randrange(10, 121) * step if step else rng.uniform(1.0, 40.0)

    values = [(rating(), rng.randrange(-50, 600)) for _ in range(700)]
    centres = sorted({rating() for _ in range(120)} | {v for v, _ in values[:60]} | {-3.0, 999.0})
    got = band_totals(
        spark.createDataFrame([*values, (None, 9), (float("nan"), 9)], "v double, w int"),
        "v",
        {"n": F.count(F.lit(1)), "w": F.sum("w")},
        spark.createDataFrame([(c,) for c in [*centres, *centres, None]], "c double"),
        "c",
        half_width,
        leaf,
    )
    expected = {}
    for c in centres:
        inside = [w for v, w in values if c - half_width <= v <= c + half_width]
        expected[c] = (len(inside), sum(inside))
    assert {r["c"]: (r["n"], r["w"]) for r in got.collect()} == expected


def test_a_million_ratings_close_together(spark):
    """They would share a cell of any grid as wide as the band; leaves follow the values instead."""
    n, step = 1_000_000, 2.0**-22
    values = spark.range(n).select((5.0 + F.col("id") * step).alias("v"), (F.col("id") % 1000).alias("w"))
    far = spark.createDataFrame([(100.0 + i, 7) for i in range(50)], "v double, w bigint")
    centres = [5.0 + k * 4001 * step for k in range(200)] + [4.5, 120.0, 149.5]
    asked = spark.createDataFrame([(c,) for c in centres], "c double")
    totals = {"n": F.count(F.lit(1)), "w": F.sum("w")}
    half = 1000 * step
    given = (values.union(far), "v", totals, asked, "c", half)
    points, counted = band_points(*given, leaf_points=50_000)
    assert counted == points.count()
    sizes = [r["count"] for r in points.groupBy("_leaf").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 100_000 and sum(sizes) == n + 50 + 2 * len(centres)
    got = {r["c"]: (r["n"], r["w"]) for r in band_totals(*given, leaf_points=50_000).collect()}
    for k, c in enumerate(centres[:200]):
        inside = range(max(0, 4001 * k - 1000), min(n - 1, 4001 * k + 1000) + 1)
        assert got[c] == (len(inside), sum(i % 1000 for i in inside))
    assert got[4.5] == (0, 0) and got[120.0] == (1, 7) and got[149.5] == (0, 0)


def test_munitions_are_worked_out_once(spark, golden, tmp_path):
    """Bands and rows both read the representative ones, however costly these are to find."""
    golden["munition"].write.parquet(str(tmp_path / "munitions"))
    stored = golden | {"munition": spark.read.parquet(str(tmp_path / "munitions"))}
    pairs = spark.createDataFrame([(1, 103)], "roster_id long, unit_id long")
    result = wide(stored, pairs, one_munition=True)
    assert result.inputFiles() and not any("munitions" in name for name in result.inputFiles())
    assert result.first()["peer_count"] == 12
