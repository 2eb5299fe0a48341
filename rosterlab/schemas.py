"""The seven tables, and the constraints a clean set of them fulfils."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from rosterlab.functions import fixed_values as fv


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(*field) for field in fields])


_INT, _LONG, _STR, _DBL, _BOOL, _TS = (
    T.IntegerType(),
    T.LongType(),
    T.StringType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)

NATION = _struct(("nation_id", _INT), ("name", _STR), ("flag_path", _STR))
CATEGORY = _struct(("category_id", _INT), ("name", _STR), ("description", _STR))
UNIT = _struct(
    ("unit_id", _LONG),
    ("nation_id", _INT),
    ("category_id", _INT),
    ("name", _STR),
    ("tier", _INT),
    ("rating", _DBL),
    ("cost", _INT),
    ("media_path", _STR),
)
SPEC = _struct(("unit_id", _LONG), ("front", _INT), ("side", _INT), ("rear", _INT))
MUNITION = _struct(
    ("munition_id", _LONG),
    ("unit_id", _LONG),
    ("name", _STR),
    ("kind", _STR),
    ("pen", _INT),
    ("is_representative", _BOOL),
)
ROSTER = _struct(
    ("roster_id", _LONG),
    ("nation_id", _INT),
    ("title", _STR),
    ("game_mode", _STR),
    ("target_rating", _DBL),
    ("created_at", _TS),
)
SLOT = _struct(("roster_id", _LONG), ("unit_id", _LONG), ("slot_no", _INT), ("role_note", _STR))

TABLES = {
    "nation": NATION,
    "category": CATEGORY,
    "unit": UNIT,
    "spec": SPEC,
    "munition": MUNITION,
    "roster": ROSTER,
    "slot": SLOT,
}

# One wide row carries a unit, its spec and its representative munition.
STAGED_UNIT = T.StructType(
    UNIT.fields
    + SPEC.fields[1:]
    + [
        T.StructField("munition_name", _STR),
        T.StructField("munition_kind", _STR),
        T.StructField("pen", _INT),
    ]
)


@dataclass(frozen=True)
class Key:
    """No two rows of ``table`` share these columns. A NULL in them never collides."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Check:
    """``holds`` (a SQL condition) is not false in any row; NULL counts as fulfilled."""

    table: str
    name: str
    holds: str


@dataclass(frozen=True)
class Reference:
    """Every non-NULL ``column`` of ``table`` occurs in ``parent``."""

    table: str
    column: str
    parent: str


KEYS = (
    Key("nation", ("nation_id",)),
    Key("nation", ("name",)),
    Key("category", ("category_id",)),
    Key("category", ("name",)),
    Key("unit", ("unit_id",)),
    Key("unit", ("nation_id", "name")),
    Key("spec", ("unit_id",)),
    Key("munition", ("munition_id",)),
    Key("roster", ("roster_id",)),
    Key("slot", ("roster_id", "slot_no")),
    Key("slot", ("roster_id", "unit_id")),
)

REQUIRED = {
    "nation": ("nation_id", "name"),
    "category": ("category_id", "name"),
    "unit": ("unit_id", "nation_id", "category_id", "name", "tier", "rating", "cost"),
    "spec": ("unit_id", "front", "side", "rear"),
    "munition": ("munition_id", "unit_id", "name", "pen", "is_representative"),
    "roster": ("roster_id", "nation_id", "title", "game_mode", "target_rating", "created_at"),
    "slot": ("roster_id", "unit_id", "slot_no"),
}

REFERENCES = (
    Reference("unit", "nation_id", "nation"),
    Reference("unit", "category_id", "category"),
    Reference("spec", "unit_id", "unit"),
    Reference("munition", "unit_id", "unit"),
    Reference("roster", "nation_id", "nation"),
    Reference("slot", "roster_id", "roster"),
    Reference("slot", "unit_id", "unit"),
)


def checks(game_modes: Sequence[str] = fv.GAME_MODES) -> tuple[Check, ...]:
    modes = ", ".join("'" + mode.replace("'", "\\'") + "'" for mode in game_modes)
    return (
        Check("unit", "tier_range", f"tier BETWEEN {fv.LOWEST_TIER} AND {fv.HIGHEST_TIER}"),
        Check("unit", "rating_low", f"rating >= {fv.LOWEST_RATING}D"),
        Check("unit", "cost_negative", "cost >= 0"),
        Check("spec", "front_negative", "front >= 0"),
        Check("spec", "side_negative", "side >= 0"),
        Check("spec", "rear_negative", "rear >= 0"),
        Check("munition", "pen_negative", "pen >= 0"),
        Check("roster", "mode_unknown", f"game_mode IN ({modes})"),
        Check("roster", "target_low", f"target_rating >= {fv.LOWEST_RATING}D"),
        Check("slot", "slot_range", f"slot_no BETWEEN {fv.FIRST_SLOT} AND {fv.LAST_SLOT}"),
    )
