"""Registration of units as a stream of raw text rows.

Every micro-batch is parsed (``operators/intake.py``); rows that cannot be read go to quarantine with their
reasons, the others are registered (``operators/changes.py``) against the units so far. Below ``target``,
``accepted``, ``rejected`` and ``quarantine`` have a folder ``version=N`` for each micro-batch. Ids
follow the highest one of earlier versions in ``request_id`` order, so a batch that is run again gives the
same ids and replaces its own version. A request counts once: one whose id is in an earlier version,
whatever its outcome was, or twice in a batch, is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from rosterlab.operators.changes import register_units
from rosterlab.operators.intake import FLOAT_FIELDS, INT_FIELDS, TEXT_FIELDS, intake_validate, split_intake
from rosterlab.plans.durable import freeze
from rosterlab.plans.numbering import highest

ACCEPTED, REJECTED, QUARANTINE = "accepted", "rejected", "quarantine"


@dataclass(frozen=True)
class IntakeFeed:
    """A feed into ``target``: new units on top of ``units`` and ``munitions``.

    ``fields`` is the schema of an accepted row besides its ids: request_id and the staged columns.
    """

    target: str
    units: DataFrame
    munitions: DataFrame
    nations: DataFrame
    categories: DataFrame
    fields: StructType
    texts: Sequence[str] = TEXT_FIELDS
    ints: Sequence[str] = INT_FIELDS
    floats: Sequence[str] = FLOAT_FIELDS

    def _schema(self, kind: str) -> StructType:
        if kind == ACCEPTED:
            ids = [StructField(c, LongType()) for c in ("unit_id", "munition_id")]
            return StructType([*self.fields.fields, *ids])
        if kind == REJECTED:
            kinds = {f.name: f for f in self.fields.fields}
            return StructType(
                [*(kinds[c] for c in ("request_id", "nation_id", "name")), StructField("reason", StringType())]
            )
        request = next(f for f in self.fields.fields if f.name == "request_id")
        return StructType([request, StructField("reasons", ArrayType(StringType()))])

    def table(self, kind: str, before: int | None = None) -> DataFrame:
        """Accepted, rejected or quarantined requests, with the ``version`` they came with."""
        schema = StructType([*self._schema(kind).fields, StructField("version", IntegerType())])
        found = self.units.sparkSession.read.schema(schema).parquet(f"{self.target.rstrip('/')}/{kind}")
        return found if before is None else found.where(F.col("version") < before)

    def start(self) -> None:
        """Make empty tables, as a version before the first micro-batch."""
        for kind in (ACCEPTED, REJECTED, QUARANTINE):
            self._write(self.units.sparkSession.createDataFrame([], self._schema(kind)), kind, -1)

    def registered(self, before: int | None = None) -> DataFrame:
        """Units so far, in the columns of ``units``."""
        new = self.table(ACCEPTED, before).select(*self.units.columns)
        return self.units.unionByName(new)

    @cached_property
    def _first_tops(self) -> tuple[int, int]:
        """Highest unit and munition id before the feed, worked out once for all batches."""
        return highest(self.units, "unit_id"), highest(self.munitions, "munition_id")

    def _tops(self, before: int) -> tuple[int, int]:
        """Highest unit and munition id before a version."""
        new = self.table(ACCEPTED, before).agg(F.max("unit_id"), F.max("munition_id")).first()
        return tuple(top if added is None else max(top, added) for top, added in zip(self._first_tops, new, strict=True))

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.select(*self._schema(kind).names).write.mode("overwrite").parquet(
            f"{self.target.rstrip('/')}/{kind}/version={version}"
        )

    def apply_batch(self, batch: DataFrame, version: int) -> None:
        """Parse, register and write one micro-batch of raw rows (all columns text but ``request_id``)."""
        known = [self.table(kind, version).select("request_id") for kind in (ACCEPTED, REJECTED, QUARANTINE)]
        once = batch.dropDuplicates(["request_id"]).join(reduce(DataFrame.union, known), "request_id", "left_anti")
        judged = freeze(intake_validate(once, self.texts, self.ints, self.floats))
        good, bad = split_intake(judged)
        fitting = good.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.fields.fields])
        result = register_units(
            fitting, self.registered(version), self.munitions, self.nations, self.categories, self._tops(version)
        )
        # The two others first: a request is known by its version in any of the three.
        self._write(bad, QUARANTINE, version)
        self._write(result.rejected, REJECTED, version)
        self._write(result.accepted, ACCEPTED, version)

    def run(self, raw: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start the feed over a streaming ``raw`` and process everything available."""
        return (
            raw.writeStream.foreachBatch(lambda batch, number: self.apply_batch(freeze(batch), number))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
