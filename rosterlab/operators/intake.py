"""Raw text rows → typed rows, or the reasons why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.functions import expressions as ex

# Required fields of a unit registration form, by the type they must have.
TEXT_FIELDS = ("name", "munition_name")
INT_FIELDS = ("nation_id", "category_id", "tier", "cost", "front", "side", "rear", "pen")
FLOAT_FIELDS = ("rating",)

_READ = "_read_"


def intake_validate(
    raw: DataFrame,
    texts: Sequence[str] = TEXT_FIELDS,
    ints: Sequence[str] = INT_FIELDS,
    floats: Sequence[str] = FLOAT_FIELDS,
) -> DataFrame:
    """Every raw row with its parsed fields and ``reasons``, one entry per bad field.

    A blank field gives ``<field>:required``, text that is not a number ``<field>:malformed``.
    Columns that are not named are carried along. Texts are stripped.
    """
    kinds = dict.fromkeys(texts, None) | dict.fromkeys(ints, "int") | dict.fromkeys(floats, "double")
    order = [c for c in raw.columns if c in kinds]
    # One step after the other, so that each field is stripped once and read once.
    stripped = raw.withColumns({c: ex.strip(F.col(c)) for c in order})
    read = {"int": ex.read_int, "double": ex.read_float}
    typed = stripped.withColumns({f"{_READ}{c}": read[kinds[c]](F.col(c)) for c in order if kinds[c]})
    value = {c: F.col(f"{_READ}{c}" if kinds[c] else c) for c in order}
    faults = [
        F.when(F.col(c).isNull() | (F.col(c) == ""), f"{c}:required").when(value[c].isNull(), f"{c}:malformed")
        for c in order
    ]
    return typed.select(
        *[value.get(c, F.col(c)).alias(c) for c in raw.columns],
        F.array_compact(F.array(*faults)).alias("reasons"),
    )


def split_intake(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the reasons, rows to be looked at by a person)."""
    clean = F.size("reasons") == 0
    return validated.where(clean).drop("reasons"), validated.where(~clean)
