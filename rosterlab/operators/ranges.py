"""Reference sync that reads only the ranges that differ.

A table is laid out in ranges of a hash of its key, one folder each, with a digest per range: rows,
and two order-free sums over hashes of whole rows. Digests are compared level by level, groups of ranges
first, then the ranges of groups that differ, so equal ranges are never read.

``RangeStore`` keeps units, specs and munitions in ranges of the unit's (nation, name), which is what a
provided unit is matched on. With each version it writes the digests that the provider had at that
sync. A range that the provider still has like that would come out as it is, since syncing twice equals
once and nothing else writes to the store; only the others are read, synced (``sync.UnitSync``) and
written as a new version. Of all other ranges a sync reads the ids alone, to tell which preferred ids are
free. If nations or categories differ from those of the last sync, every range counts as different, as rows
that were refused may now be accepted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rosterlab.functions import fixed_values as fv
from rosterlab.operators.sync import UnitSync
from rosterlab.plans.durable import freeze, new_folder

_KEY = ("nation_id", "name")
_DIGEST = "range int, rows bigint, a decimal(38,0), b decimal(38,0)"
_GROUP = 64


def range_of(keys: Sequence[str], ranges: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int").alias("range")


def digests(rows: DataFrame) -> DataFrame:
    """(range, rows, a, b) of a table with its ``range``: equal for equal rows in any order."""
    columns = sorted(c for c in rows.columns if c != "range")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return rows.groupBy("range").agg(
        F.count(F.lit(1)).alias("rows"),
        total(1).cast("decimal(38,0)").alias("a"),
        total(2).cast("decimal(38,0)").alias("b"),
    )


def differing(one: DataFrame, two: DataFrame) -> list[int]:
    """Ranges whose digests differ, or that one side lacks; by groups first."""

    def compared(left: DataFrame, right: DataFrame, at: str) -> DataFrame:
        r = right.select(*[F.col(c).alias(f"_{c}") for c in (at, "rows", "a", "b")])
        equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("rows", "a", "b")]
        joined = left.join(r, F.col(at) == F.col(f"_{at}"), "full")
        return joined.where(~(equal[0] & equal[1] & equal[2])).select(F.coalesce(at, f"_{at}").alias(at))

    def grouped(side: DataFrame) -> DataFrame:
        sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("a", "b")]
        group = F.floor(F.col("range") / _GROUP).alias("group")
        return side.groupBy(group).agg(F.sum("rows").alias("rows"), *sums)

    groups = [r["group"] for r in compared(grouped(one), grouped(two), "group").collect()]
    inside = F.floor(F.col("range") / _GROUP).isin(groups)
    found = compared(one.where(inside), two.where(inside), "range").collect()
    return sorted(r["range"] for r in found)


@dataclass(frozen=True)
class RangedTable:
    """Rows below ``root`` in folders by range, and their digests beside them."""

    root: str

    def write(self, rows: DataFrame, keys: Sequence[str], ranges: int) -> None:
        laid = rows.withColumn("range", range_of(keys, ranges))
        # One file a range where they are small; a range that is large is split.
        laid.hint("rebalance", "range").write.mode("overwrite").partitionBy("range").parquet(f"{self.root}/rows")
        stored = rows.sparkSession.read.schema(laid.schema).parquet(f"{self.root}/rows")
        digests(stored).write.mode("overwrite").parquet(f"{self.root}/digests")

    def digests(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_DIGEST).parquet(f"{self.root}/digests")

    def rows(self, spark: SparkSession, only: Sequence[int]) -> DataFrame:
        found = spark.read.parquet(f"{self.root}/rows")
        return found.where(F.col("range").isin([int(r) for r in only])).drop("range")


@dataclass(frozen=True)
class RangeResult:
    """What a sync did: the ranges that it read, and refused provided rows of these."""

    ranges: list[int]
    rejected: DataFrame | None


_STATE = "kind string, range int, version int, rows bigint, a decimal(38,0), b decimal(38,0)"
_HELD, _OFFERED, _NATIONS, _CATEGORIES = "held", "offered", "nations", "categories"
TABLES = ("unit", "spec", "munition")


class RangeStore:
    """Units, specs and munitions below ``root``, in ranges and versions.

    ``state/number=N`` tells which version holds each range and what the provider's digests were; the
    newest number counts, so a sync that breaks off leaves the store as it was.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, StructType], ranges: int = 256) -> None:
        self.spark, self.root, self.ranges, self.schemas = spark, root.rstrip("/"), ranges, dict(schemas)

    def _state(self) -> tuple[int, dict[int, int], DataFrame]:
        """Newest number, range → version, and the rows of that state: a few numbers per range."""
        stored = self.spark.read.schema(f"{_STATE}, number int").parquet(f"{self.root}/state")
        number = stored.agg(F.max("number")).first()[0]
        rows = stored.where(F.col("number") == number).drop("number")
        held = rows.where(F.col("kind") == _HELD).select("range", "version").collect()
        return number, {r["range"]: r["version"] for r in held}, rows

    def _save(self, number: int, versions: dict[int, int], digests_of: Mapping[str, DataFrame]) -> None:
        held = self.spark.createDataFrame([(r, v) for r, v in sorted(versions.items())], "range int, version int")
        rows = self.spark.createDataFrame([], _STATE).unionByName(
            held.withColumn("kind", F.lit(_HELD)), allowMissingColumns=True
        )
        for kind, found in digests_of.items():
            rows = rows.unionByName(found.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
        rows.coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/state/number={number}"
        )

    def _write(self, tables: Mapping[str, DataFrame], version: int) -> None:
        units = tables["unit"].withColumn("range", range_of(_KEY, self.ranges))
        of_unit = units.groupBy("unit_id").agg(F.min("range").alias("range"))
        for name in TABLES:
            laid = units
            if name != "unit":
                # Rows of no unit stay together by its id.
                alone = F.pmod(F.xxhash64("unit_id"), F.lit(self.ranges)).cast("int")
                laid = tables[name].join(of_unit, "unit_id", "left").withColumn("range", F.coalesce("range", alone))
            laid.select(*self.schemas[name].names, "range").hint("rebalance", "range").write.mode(
                "overwrite"
            ).partitionBy("range").parquet(f"{self.root}/{name}/version={version}")

    def load(self, units: DataFrame, specs: DataFrame, munitions: DataFrame) -> None:
        """First version."""
        self._write({"unit": units, "spec": specs, "munition": munitions}, 0)
        self._save(0, dict.fromkeys(range(self.ranges), 0), {})

    def table(self, name: str, only: Sequence[int] | None = None) -> DataFrame:
        """Present rows of a table, of all ranges or only some."""
        _, versions, _ = self._state()
        by_version: dict[int, list[int]] = {}
        for r in range(self.ranges) if only is None else only:
            by_version.setdefault(versions[r], []).append(r)
        schema = self.schemas[name]
        found = self.spark.createDataFrame([], schema)
        for version, inside in sorted(by_version.items()):
            stored = self.spark.read.schema(StructType([*schema.fields, StructField("range", IntegerType())]))
            rows = stored.parquet(f"{self.root}/{name}/version={version}").where(F.col("range").isin(inside))
            found = found.unionByName(rows.select(*schema.names))
        return found

    def sync(
        self,
        provider: RangedTable,
        nations: DataFrame,
        categories: DataFrame,
        default: str = fv.DEFAULT_MEDIA_PATH,
        order_by: str = "position",
    ) -> RangeResult:
        """Bring the store up to date with ``provider``, laid out by (nation_id, name) in as many ranges."""
        number, versions, state = self._state()
        now = {
            _OFFERED: provider.digests(self.spark),
            _NATIONS: digests(nations.withColumn("range", F.lit(0))),
            _CATEGORIES: digests(categories.withColumn("range", F.lit(0))),
        }
        seen = {kind: state.where(F.col("kind") == kind).select("range", "rows", "a", "b") for kind in now}
        if any(differing(now[kind], seen[kind]) for kind in (_NATIONS, _CATEGORIES)):
            todo = list(range(self.ranges))
        else:
            todo = differing(now[_OFFERED], seen[_OFFERED])
        if not todo:
            return RangeResult([], None)
        near = {name: self.table(name, todo) for name in TABLES}
        synced = UnitSync(
            near["unit"], near["spec"], near["munition"], provider.rows(self.spark, todo), nations, categories,
            default, order_by, self.table("unit").select("unit_id"), self.table("munition").select("munition_id"),
        )
        after = {"unit": freeze(synced.unit), "spec": freeze(synced.spec), "munition": freeze(synced.munition)}
        self._write(after, number + 1)
        self._save(number + 1, versions | dict.fromkeys(todo, number + 1), now)
        return RangeResult(todo, synced.rejected)


def laid_out(rows: DataFrame, ranges: int) -> RangedTable:
    """Provided rows as a table in ranges, in a folder of its own."""
    table = RangedTable(new_folder(rows.sparkSession, "provider"))
    table.write(rows, _KEY, ranges)
    return table
