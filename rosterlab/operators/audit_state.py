"""Audits that follow changes instead of reading the tables again.

A change set has rows that came (``weight`` 1) and rows that went (-1). What an audit needs to know of a
table adds up: how many rows hold each key value, and, per reference and value, how many rows name it and
how many parents have it. A change set's own counts are therefore enough, together with the stored
counts of the values that it touches, to tell how each rule's figures move.

Below ``target``, ``counts/version=N/bucket=B`` holds the signed counts of version N by a hash of the
value, and ``report/version=N`` by how much each rule's figures moved with it; the present report is their
sum. A version reads only the buckets its values fall in (at most ``buckets`` small numbers reach the
driver), and writing it again replaces it. Figures are those of ``operators/quality.py``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlab import schemas

UNIQUE, REFERENCE, REQUIRED, CHECK = "unique", "reference", "required", "check"
_RULE = ("kind", "table_name", "rule")
_COUNTS = "kind string, table_name string, rule string, value string, held bigint, parents bigint"
_REPORT = "kind string, table_name string, rule string, violations bigint, rows_involved bigint"


def weighted(came: DataFrame | None = None, went: DataFrame | None = None) -> DataFrame:
    """One change set of a table from rows that came and rows that went."""
    parts = [d.withColumn("weight", F.lit(w)) for d, w in ((came, 1), (went, -1)) if d is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _value(columns: Sequence[str]) -> Column:
    """The key value as text, unambiguous for any texts in it."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


@dataclass(frozen=True)
class AuditLog:
    target: str
    keys: Sequence[schemas.Key] = schemas.KEYS
    references: Sequence[schemas.Reference] = schemas.REFERENCES
    required: Mapping[str, Sequence[str]] = field(default_factory=lambda: schemas.REQUIRED)
    checks: Sequence[schemas.Check] = ()
    buckets: int = 64

    def tally(self, changes: Mapping[str, DataFrame]) -> DataFrame:
        """Signed counts of a change set (by table, with ``weight``), per rule and value.

        A rule's rows are added up once, by the columns of the key where one table holds them all, so
        the values become text after they have met.
        """
        named: dict[tuple[str, str, str], list[DataFrame]] = {}
        parts = []
        weight = F.sum("weight").cast("bigint")
        nothing = F.lit(0).cast("bigint")

        def labelled(rule: tuple[str, str, str], rows: DataFrame) -> DataFrame:
            names = [F.lit(text).alias(column) for text, column in zip(rule, _RULE, strict=True)]
            return rows.where("held <> 0 OR parents <> 0").select(*names, "value", "held", "parents")

        def add(kind: str, table: str, rule: str, rows: DataFrame, value: Column, parents: bool = False) -> None:
            held, of = (nothing, F.col("weight")) if parents else (F.col("weight"), nothing)
            named.setdefault((kind, table, rule), []).append(
                rows.select(value.alias("value"), held.cast("bigint").alias("held"), of.cast("bigint").alias("parents"))
            )

        for key in self.keys:
            if key.table in changes:
                whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key.columns])
                summed = changes[key.table].where(whole).groupBy(*key.columns).agg(weight.alias("held"))
                valued = summed.select(_value(key.columns).alias("value"), "held", nothing.alias("parents"))
                parts.append(labelled((UNIQUE, key.table, ",".join(key.columns)), valued))
        for ref in self.references:
            if ref.table in changes:
                rows = changes[ref.table].where(F.col(ref.column).isNotNull())
                add(REFERENCE, ref.table, ref.column, rows, _value([ref.column]))
            if ref.parent in changes:
                parent = f"{ref.parent}_id"
                rows = changes[ref.parent].where(F.col(parent).isNotNull())
                add(REFERENCE, ref.table, ref.column, rows, _value([parent]), parents=True)
        for table, columns in self.required.items():
            for c in columns if table in changes else ():
                add(REQUIRED, table, c, changes[table].where(F.col(c).isNull()), F.lit(""))
        for check in self.checks:
            if check.table in changes:
                broken = changes[check.table].where(~F.expr(check.holds))
                add(CHECK, check.table, check.name, broken, F.lit(""))
        both = [F.sum(c).cast("bigint").alias(c) for c in ("held", "parents")]
        parts += [
            labelled(rule, reduce(DataFrame.unionByName, rows).groupBy("value").agg(*both))
            for rule, rows in named.items()
        ]
        if not parts:
            raise ValueError("no rule looks at these tables")
        return reduce(DataFrame.unionByName, parts)

    def _path(self, table: str) -> str:
        return f"{self.target.rstrip('/')}/{table}"

    @staticmethod
    def _figures(held: str, parents: str) -> tuple[Column, Column]:
        """Violations and the rows in them, of one value."""
        held, parents = F.col(held), F.col(parents)
        broken = (
            F.when(F.col("kind") == UNIQUE, held > 1)
            .when(F.col("kind") == REFERENCE, (held > 0) & (parents <= 0))
            .otherwise(held > 0)
        )
        # A missing value or a broken check is a violation a row.
        one = F.when(F.col("kind").isin(UNIQUE, REFERENCE), F.lit(1)).otherwise(held)
        return tuple(F.when(broken, figure).otherwise(0).cast("bigint") for figure in (one, held))

    def apply(self, changes: Mapping[str, DataFrame], version: int) -> None:
        """Take in one change set as ``version``; versions are applied in order, from 0 on."""
        place = F.pmod(F.xxhash64(*_RULE, "value"), F.lit(self.buckets)).cast("int")
        own = f"{self._path('counts')}/version={version}"
        counted = self.tally(changes).withColumn("bucket", place)
        counted.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(own)
        spark = counted.sparkSession
        delta = spark.read.schema(f"{_COUNTS}, bucket int").parquet(own)
        nothing = F.lit(0).cast("bigint")
        met = delta.select(
            *_RULE, "value", F.lit(True).alias("touched"), nothing.alias("was"), nothing.alias("had"), "held", "parents"
        )
        if version > 0:
            found = delta.groupBy(*_RULE).agg(F.collect_set("bucket").alias("buckets")).collect()
            stored = spark.read.schema(f"{_COUNTS}, bucket int, version int").parquet(self._path("counts"))
            buckets = {bucket for r in found for bucket in r["buckets"]}
            # Rules that the change set does not move are left out while reading.
            moved = reduce(
                lambda a, b: a | b,
                [reduce(lambda a, b: a & b, [F.col(c) == r[c] for c in _RULE]) for r in found], F.lit(False),
            )
            earlier = stored.where((F.col("version") < version) & F.col("bucket").isin(buckets) & moved)
            met = met.unionByName(
                earlier.select(
                    *_RULE, "value", F.lit(False).alias("touched"), F.col("held").alias("was"),
                    F.col("parents").alias("had"), "held", "parents",
                )
            )
            # Stored counts and those of the change set meet once, in one row a value; a tally alone has one already.
            sums = [F.sum(c).cast("bigint").alias(c) for c in ("was", "had", "held", "parents")]
            met = met.groupBy(*_RULE, "value").agg(F.max("touched").alias("touched"), *sums).where("touched")
        now, before = self._figures("held", "parents"), self._figures("was", "had")
        names = ("violations", "rows_involved")
        report = met.select(
            *_RULE, *[(new - old).alias(name) for name, new, old in zip(names, now, before, strict=True)]
        ).where("violations <> 0 OR rows_involved <> 0")
        report.groupBy(*_RULE).agg(*[F.sum(c).cast("bigint").alias(c) for c in names]).write.mode(
            "overwrite"
        ).parquet(f"{self._path('report')}/version={version}")

    def report(self, spark) -> DataFrame:
        """(kind, table_name, rule, violations, rows_involved) of every rule, also of those without any."""
        rules = [(UNIQUE, k.table, ",".join(k.columns)) for k in self.keys]
        rules += [(REFERENCE, r.table, r.column) for r in self.references]
        rules += [(REQUIRED, t, c) for t, columns in self.required.items() for c in columns]
        rules += [(CHECK, c.table, c.name) for c in self.checks]
        stored = spark.read.schema(f"{_REPORT}, version int").parquet(self._path("report")).drop("version")
        nothing = spark.createDataFrame([(*r, 0, 0) for r in rules], _REPORT)
        both = [F.sum(c).cast("bigint").alias(c) for c in ("violations", "rows_involved")]
        return nothing.unionByName(stored).groupBy(*_RULE).agg(*both)
