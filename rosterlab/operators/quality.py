"""Constraint audits: what a database would refuse on write, counted over stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab import schemas

Tables = Mapping[str, DataFrame]


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _long(counts: DataFrame, table: str, rules: Sequence[str]) -> DataFrame:
    """One wide row of counts → one row per rule."""
    entries = F.array(
        *[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in rules]
    )
    return counts.select(F.lit(table).alias("table_name"), F.explode(entries).alias("e")).select(
        "table_name", "e.*"
    )


def duplicate_keys(tables: Tables, key: schemas.Key) -> DataFrame:
    """Key values that occur more than once, as text, with their number of rows."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key.columns])
    return (
        tables[key.table]
        .where(complete)
        .groupBy(*key.columns)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where("row_count > 1")
        .select(
            F.lit(key.table).alias("table_name"),
            F.lit(",".join(key.columns)).alias("rule"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in key.columns]).alias("key_value"),
            "row_count",
        )
    )


def audit_unique(tables: Tables, keys: Sequence[schemas.Key] = schemas.KEYS) -> DataFrame:
    """Per key rule: how many key values are shared and how many rows share them."""
    return _stack(
        [
            duplicate_keys(tables, key)
            .agg(
                F.count(F.lit(1)).alias("violations"),
                F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("rows_involved"),
            )
            .select(
                F.lit(key.table).alias("table_name"),
                F.lit(",".join(key.columns)).alias("rule"),
                "violations",
                "rows_involved",
            )
            for key in keys
            if key.table in tables
        ]
    )


def audit_unique_keys(tables: Tables, keys: Sequence[schemas.Key] = schemas.KEYS) -> DataFrame:
    """The shared key values themselves."""
    return _stack([duplicate_keys(tables, key) for key in keys if key.table in tables])


def audit_not_null(
    tables: Tables, required: Mapping[str, Sequence[str]] = schemas.REQUIRED
) -> DataFrame:
    """NULLs per required column; one pass over each table."""
    return _stack(
        [
            _long(
                tables[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]),
                table,
                columns,
            )
            for table, columns in required.items()
            if table in tables
        ]
    )


def audit_check(tables: Tables, checks: Sequence[schemas.Check] | None = None) -> DataFrame:
    """Rows that break each check; one pass over each table. A check over NULL is not broken."""
    rules = schemas.checks() if checks is None else checks
    parts = []
    for table in dict.fromkeys(rule.table for rule in rules):
        if table in tables:
            own = [rule for rule in rules if rule.table == table]
            counts = tables[table].agg(
                *[F.count_if(~F.expr(rule.holds)).alias(rule.name) for rule in own]
            )
            parts.append(_long(counts, table, [rule.name for rule in own]))
    return _stack(parts)


def dangling(tables: Tables, reference: schemas.Reference) -> DataFrame:
    """Values without a parent row, with the number of rows that hold them.

    Rows are counted per value before the join, so a value held by most rows is one row there.
    """
    parent_key = f"{reference.parent}_id"
    return (
        tables[reference.table]
        .where(F.col(reference.column).isNotNull())
        .groupBy(F.col(reference.column).alias(parent_key))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .join(tables[reference.parent].select(parent_key), parent_key, "left_anti")
        .select(
            F.lit(reference.table).alias("table_name"),
            F.lit(reference.column).alias("rule"),
            F.col(parent_key).cast("string").alias("key_value"),
            "row_count",
        )
    )


def audit_fk(
    tables: Tables, references: Sequence[schemas.Reference] = schemas.REFERENCES
) -> DataFrame:
    """Per reference: distinct values without a parent and the rows that hold them."""
    return _stack(
        [
            dangling(tables, ref)
            .agg(
                F.count(F.lit(1)).alias("violations"),
                F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("rows_involved"),
            )
            .select(
                F.lit(ref.table).alias("table_name"),
                F.lit(ref.column).alias("rule"),
                "violations",
                "rows_involved",
            )
            for ref in references
            if ref.table in tables and ref.parent in tables
        ]
    )
