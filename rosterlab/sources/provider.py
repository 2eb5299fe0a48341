"""Reference rows from a provider behind one interface, as a Spark data source.

A provider is any class with the methods of :class:`Provider`; ``spark.read.format("roster_provider")``
names it as ``module:Class`` and reads one of its tables, a part a task::

    register(spark)
    provided(spark, "unit", "mycompany.stock:Stock", path="s3://bucket/stock")

The class is made anew in the driver and in every task, with the options of the read, and has to be
importable there. Values must fit the table's types, or the read stops.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from rosterlab.schemas import STAGED_UNIT, TABLES

FORMAT = "roster_provider"
STAGED = "staged_unit"


class Provider(Protocol):
    """Where reference rows come from."""

    def parts(self, table: str) -> list[Any]:
        """What can be read apart: small values that tell a task its part."""

    def rows(self, table: str, part: Any) -> Iterator[dict[str, Any]]:
        """The rows of a part, by column name; columns that are left out are NULL."""


def schema_of(table: str) -> StructType:
    return STAGED_UNIT if table == STAGED else TABLES[table]


def _made(options: dict[str, str]) -> Provider:
    module, _, name = options["provider"].partition(":")
    own = {k: v for k, v in options.items() if k not in ("provider", "table")}
    return getattr(import_module(module), name)(**own)


class _Part(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.names = options, schema.names

    def partitions(self) -> list[InputPartition]:
        return [_Part(part) for part in _made(self.options).parts(self.options["table"])]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # the provider has no parts of this table
            return
        for row in _made(self.options).rows(self.options["table"], partition.value):
            yield tuple(row.get(name) for name in self.names)


class ProviderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return schema_of(self.options["table"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProviderSource)


def provided(spark: SparkSession, table: str, provider: str, **options: str) -> DataFrame:
    """Rows of ``table`` (a table, or ``staged_unit``) from the provider ``module:Class``."""
    return spark.read.format(FORMAT).options(provider=provider, table=table, **options).load()


class LineFiles:
    """A provider of JSON lines: a folder per table below ``path``, a part for each file."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def parts(self, table: str) -> list[str]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(f"{self.root.rstrip('/')}/{table}", recursive=True))
        return sorted(f.path for f in found if f.is_file and f.base_name[0] not in "._")

    def rows(self, table: str, part: str) -> Iterator[dict[str, Any]]:
        with self.files.open_input_stream(part) as stream:
            held = b""
            while chunk := stream.read(1 << 20):
                *lines, held = (held + chunk).split(b"\n")
                yield from (json.loads(line) for line in lines if line.strip())
            if held.strip():
                yield json.loads(held)
