import pytest
from pyspark.sql import functions as F

from rosterlab.functions import expressions as ex
from rosterlab.functions import fixed_values as fv


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_relabel_passes_unknown_names_through(spark):
    found = values(spark, ["USA", "usa", None, "Israel"], lambda c: ex.relabel(c, fv.NATION_LABELS))
    assert found == ["미국", "usa", None, "이스라엘"]
    assert values(spark, ["a"], lambda c: ex.relabel(c, {})) == ["a"]


def test_blank_and_unset(spark):
    texts = [None, "", "  ", "\t\n", "　", "x", "def"]
    assert values(spark, texts, ex.is_blank) == [True] * 5 + [False, False]
    # A tab alone is not "unset": only spaces are trimmed there.
    assert values(spark, texts, lambda c: ex.is_unset(c, "def")) == [
        True, True, True, False, False, False, True,
    ]


@pytest.mark.parametrize(
    ("keyword", "expected"),
    [
        ("alph", [True, False, False, False]),
        ("A_P", [True, False, False, False]),
        ("a%a", [True, False, True, True]),
        ("_50%", [False, True, False, False]),
        ("\\", [False, False, True, False]),
        ("a\\b", [False, False, True, False]),
    ],
)
def test_contains_keeps_wildcards_and_plain_backslash(spark, keyword, expected):
    names = ["Alpha", "Zeta 50", "Eta\\x a\\b", "beta gamma"]
    assert values(spark, names, lambda c: ex.contains_ci(c, keyword)) == expected


def test_numbers_in_text(spark):
    texts = ["7", " 7 ", "+7", "-0", "7.5", "1_0", "", None, "99999999999", "x", "1e3"]
    assert values(spark, texts, ex.parse_int) == [
        7, 7, 7, 0, None, None, None, None, None, None, None,
    ]
    texts = ["7", " 7.5 ", ".5", "5.", "1e3", "nan", "1d", "1_0.0", "", None, "-2.5E-1"]
    assert values(spark, texts, ex.parse_float) == [
        7.0, 7.5, 0.5, 5.0, 1000.0, None, None, None, None, None, -0.25,
    ]


def test_verdict_edges_belong_to_the_outer_class(spark):
    gaps = [35.0, 34.999, 15.0, 14.999, 5.0, 4.999, 0.0, -4.999, -5.0, -14.999, -15.0, -34.999, -35.0]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(gaps)], "i int, g double")
    words = [r["v"] for r in df.select("i", ex.verdict(F.col("g")).alias("v")).orderBy("i").collect()]
    v = fv.VERDICTS
    assert words == [
        v["very_high"], v["high"], v["high"], v["slightly_high"], v["slightly_high"], v["similar"],
        v["similar"], v["similar"], v["slightly_low"], v["slightly_low"], v["low"], v["low"],
        v["very_low"],
    ]


def test_gap_without_average_is_zero(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, 0.0), (5.0, 4.0)], "s double, a double")
    gaps = [r["g"] for r in df.select(ex.percent_gap(F.col("s"), F.col("a")).alias("g")).collect()]
    assert gaps == [0.0, 0.0, 25.0]
