"""Reading and writing the tables, one folder of parquet each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from rosterlab.schemas import STAGED_UNIT, TABLES

# Formats whose readers turn a value that they cannot read into NULL unless told otherwise.
_TEXT_FORMATS = ("csv", "json")
_LOAD = "_first_load"


@dataclass(frozen=True)
class Catalogue:
    """The seven tables as lazy DataFrames."""

    nation: DataFrame
    category: DataFrame
    unit: DataFrame
    spec: DataFrame
    munition: DataFrame
    roster: DataFrame
    slot: DataFrame


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared types, so no file is opened to infer them."""
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_catalogue(spark: SparkSession, root: str) -> Catalogue:
    return Catalogue(**{name: read_table(spark, root, name) for name in TABLES})


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def reference_source(
    spark: SparkSession, path: str, name: str, file_format: str = "parquet", **options: str
) -> DataFrame:
    """Reference rows for ``name`` from outside files (parquet, csv, json, orc).

    ``name`` is a table or ``staged_unit``, the wide row of a unit, its spec and its munition. A
    value of a text file that does not fit its type stops the read; pass ``mode`` for another way.
    """
    schema = STAGED_UNIT if name == "staged_unit" else TABLES[name]
    if file_format in _TEXT_FORMATS:
        options = {"mode": "FAILFAST"} | options
    return spark.read.schema(schema).options(**options).format(file_format).load(path)


def append_rows(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table and the new rows, matched by column name."""
    return table.unionByName(new.select(*table.columns))


def write_table(
    df: DataFrame,
    root: str,
    name: str,
    mode: str = "errorifexists",
    cluster_by: Sequence[str] = (),
) -> None:
    """Store a snapshot of a table. Snapshots are written to a new root, never over their input.

    With ``cluster_by`` the rows are range-sorted by these columns first, so that filters on
    them skip whole files and row groups; (nation_id, rating) suits the unit search.
    """
    rows = df.select(*TABLES[name].fieldNames())
    laid = rows.sort(*cluster_by) if cluster_by else rows
    laid.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store as a catalog table bucketed and sorted by ``key``.

    Rosters and slots bucketed alike by roster_id meet without a shuffle; likewise units,
    specs and munitions by unit_id.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def _holds_rows(spark: SparkSession, root: str, name: str) -> bool:
    try:
        return not read_table(spark, root, name).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _load_is_open(spark: SparkSession, root: str) -> bool:
    try:
        mark = spark.read.schema("open boolean").parquet(f"{root.rstrip('/')}/{_LOAD}")
        return not mark.where("open").isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _mark_load(spark: SparkSession, root: str, is_open: bool) -> None:
    mark = spark.range(1).selectExpr(f"{str(is_open).lower()} AS open")
    mark.coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{_LOAD}")


def seed(spark: SparkSession, root: str, provided: dict[str, DataFrame]) -> bool:
    """First load: write the provided tables unless ``nation`` already holds rows.

    Returns whether anything was written. ``nation`` goes last, so a load that broke off
    is taken up again by the next call; a mark beside the tables tells its rows from others.
    Rows that no open load has written are never replaced: the load is refused.
    """
    resumed = _load_is_open(spark, root)
    if _holds_rows(spark, root, "nation"):
        if resumed:
            _mark_load(spark, root, False)
        return False
    if not resumed:
        foreign = [name for name in sorted(provided) if _holds_rows(spark, root, name)]
        if foreign:
            raise ValueError(f"{root} has no nations, but rows in {', '.join(foreign)}")
        _mark_load(spark, root, True)
    for name in sorted(provided, key=lambda table: table == "nation"):
        write_table(provided[name], root, name, mode="overwrite")
    _mark_load(spark, root, False)
    return True
