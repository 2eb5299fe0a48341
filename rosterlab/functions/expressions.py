"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import sys
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlab.functions import fixed_values as fv

# Every character that a Python ``strip()`` removes; SQL TRIM alone removes only spaces.
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# Text forms accepted for a whole number and for a decimal number.
INT_FORM = r"^[+-]?[0-9]+$"
FLOAT_FORM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def relabel(col: Column, labels: Mapping[str, str]) -> Column:
    """Replace the names listed in ``labels``; any other name passes through."""
    arms = reduce(
        lambda chain, pair: chain.when(col == pair[0], F.lit(pair[1])), labels.items(), F
    )
    return arms.otherwise(col) if labels else col


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    """NULL, empty or white space only."""
    return col.isNull() | (strip(col) == "")


def is_unset(col: Column, default: str) -> Column:
    """NULL, spaces only, or still the default value."""
    return col.isNull() | (F.trim(col) == "") | (col == default)


def contains_ci(col: Column, keyword: str) -> Column:
    """Case-insensitive LIKE '%keyword%'; ``%`` and ``_`` in the keyword stay wildcards.

    LIKE in Spark always has an escape character, so one is picked that the keyword lacks.
    """
    word = keyword.lower()
    escape = next(c for c in map(chr, range(1, sys.maxunicode)) if c not in word and c not in "%_")
    return F.like(F.lower(col), F.lit(f"%{word}%"), F.lit(escape))


def read_int(text: Column) -> Column:
    """Whole number in stripped text, NULL when the text is not one."""
    return F.when(text.rlike(INT_FORM), text.try_cast("int"))


def read_float(text: Column) -> Column:
    """Decimal number in stripped text, NULL when the text is not one."""
    return F.when(text.rlike(FLOAT_FORM), text.try_cast("double"))


def parse_int(col: Column) -> Column:
    """Whole number in the text, NULL when the text is not one."""
    return read_int(strip(col))


def parse_float(col: Column) -> Column:
    """Decimal number in the text, NULL when the text is not one."""
    return read_float(strip(col))


def percent_gap(selected: Column, average: Column) -> Column:
    """Difference from the average in percent; 0 when there is no average to compare with."""
    base = F.coalesce(average, F.lit(0.0))
    return F.when(base == 0, F.lit(0.0)).otherwise((selected - base) / base * 100)


def verdict(gap: Column, words: Mapping[str, str] = fv.VERDICTS) -> Column:
    """Word for an unrounded percentage gap. The edges belong to the outer class."""
    slight, clear, strong = fv.VERDICT_EDGES
    return (
        F.when(gap >= strong, words["very_high"])
        .when(gap >= clear, words["high"])
        .when(gap >= slight, words["slightly_high"])
        .when(gap <= -strong, words["very_low"])
        .when(gap <= -clear, words["low"])
        .when(gap <= -slight, words["slightly_low"])
        .otherwise(words["similar"])
    )


def first_reason(*cases: tuple[Column, str]) -> Column:
    """Name of the first case that holds, NULL when none does. A NULL condition does not hold."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in cases])
