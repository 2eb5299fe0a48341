"""Bringing stored reference tables up to date with a provider. Syncing twice equals once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlab.functions import expressions as ex
from rosterlab.functions import fixed_values as fv
from rosterlab.operators.changes import flagged, staged_faults
from rosterlab.operators.media import media_backfill
from rosterlab.plans.durable import freeze
from rosterlab.plans.numbering import highest, number_rows

# A provided unit is the stored one with the same nation and name.
_MATCH = ["nation_id", "name"]


@dataclass(frozen=True)
class DimSync:
    table: DataFrame
    rejected: DataFrame


def sync_dims(table: DataFrame, provided: DataFrame, key: str, order_by: str = "position") -> DimSync:
    """Insert provided rows whose id is new; a stored row is never updated.

    A new id whose name is taken (stored, or by an earlier provided row) is refused, and so is a
    row without an id or, if its id is new, without a name. Of several other provided rows with
    one id, the first in ``order_by`` counts.
    """
    others = [c for c in table.columns if c != key]
    unknown = provided.join(table.select(key), key, "left_anti")
    incomplete = unknown.where(F.col(key).isNull() | F.col("name").isNull()).select(
        key,
        "name",
        F.when(F.col(key).isNull(), "id_missing").otherwise("name_missing").alias("reason"),
    )
    firsts = (
        unknown.where(F.col(key).isNotNull() & F.col("name").isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(order_by, *others)).alias("r"))
        .select(key, "r.*")
    )
    new = firsts
    stored = table.select("name", F.lit(True).alias("_stored"), F.lit(None).alias("_at"))
    names = (
        stored.unionByName(
            new.select("name", F.lit(False).alias("_stored"), F.struct(order_by, key).alias("_at"))
        )
        .groupBy("name")
        .agg(F.max("_stored").alias("_stored"), F.min("_at").alias("_first"))
    )
    judged = new.join(names, "name")
    wins = ~F.col("_stored") & (F.struct(order_by, key) == F.col("_first"))
    return DimSync(
        table.unionByName(judged.where(wins).select(*table.columns)),
        judged.where(~wins)
        .select(key, "name", F.lit("name_taken").alias("reason"))
        .unionByName(incomplete),
    )


class UnitSync:
    """Stored units brought up to date with a provider; each table is worked out when asked for.

    Units are matched on nation and exact name. A stored unit only gets its media path
    filled where that is unset. A new unit keeps its preferred id if that is free, others get
    ids after the highest one; free preferred ids are reserved first. Missing specs and
    representative munitions are added, existing ones never changed.

    ``provided`` has the staged columns, ``preferred_id`` and ``order_by``; several rows for one
    unit count in that order: the first gives the values, later ones can only fill the path.

    A row is refused as a whole, with its reason in ``rejected``, if a value that it would have to
    give is missing or breaks a rule of the tables: the unit's for a new unit, the spec's or the
    munition's where the unit has none yet. Refused rows take no part in anything else.

    ``units``, ``specs`` and ``munitions`` may be the part of a store that the provided rows can match;
    ``all_ids`` and ``all_munition_ids`` then have the ids in use in all of it.
    """

    def __init__(
        self,
        units: DataFrame,
        specs: DataFrame,
        munitions: DataFrame,
        provided: DataFrame,
        nations: DataFrame,
        categories: DataFrame,
        default: str = fv.DEFAULT_MEDIA_PATH,
        order_by: str = "position",
        all_ids: DataFrame | None = None,
        all_munition_ids: DataFrame | None = None,
    ):
        self._all_ids = units.select("unit_id") if all_ids is None else all_ids
        self._all_shots = munitions if all_munition_ids is None else all_munition_ids
        self._units, self._specs, self._munitions = units, specs, munitions
        self._nations, self._categories = nations, categories
        self._provided, self._default, self._order = provided, default, order_by
        taken = (*_MATCH, order_by, "media_path", "preferred_id")
        self._values = [c for c in provided.columns if c not in taken]

    @cached_property
    def _judged(self) -> DataFrame:
        """Provided rows with the stored unit's id (NULL: new) and ``_reason`` (NULL: accepted)."""
        shown = self._munitions.where("is_representative").select("unit_id").distinct()
        stored = (
            self._units.groupBy(*_MATCH)
            .agg(F.min("unit_id").alias("unit_id"))
            .join(flagged(self._specs.select("unit_id").distinct(), "_has_spec"), "unit_id", "left")
            .join(flagged(shown, "_has_shot"), "unit_id", "left")
            .withColumnRenamed("unit_id", "_stored_id")
        )
        new = F.col("_stored_id").isNull()
        no_spec, no_shot = F.col("_has_spec").isNull(), F.col("_has_shot").isNull()

        def absent(*columns: str) -> Column:
            return reduce(or_, (F.col(c).isNull() for c in columns))

        missing = (
            F.col("nation_id").isNull()
            | (new & absent("category_id", "tier", "rating", "cost"))
            | (no_spec & absent("front", "side", "rear"))
            | (no_shot & absent("munition_name", "pen"))
        )
        reason = ex.first_reason(
            (F.col("name").isNull(), "name_missing"),
            (missing, "value_missing"),
            *staged_faults(new, no_spec, no_shot),
        )
        return (
            self._provided.join(stored, _MATCH, "left")
            .join(flagged(self._nations.select("nation_id"), "_nation"), "nation_id", "left")
            .join(flagged(self._categories.select("category_id"), "_category"), "category_id", "left")
            .select(*self._provided.columns, "_stored_id", reason.alias("_reason"))
        )

    @cached_property
    def rejected(self) -> DataFrame:
        """Refused provided rows: their place, nation, name and the reason."""
        return self._judged.where("_reason IS NOT NULL").select(
            self._order, *_MATCH, F.col("_reason").alias("reason")
        )

    @cached_property
    def _offers(self) -> DataFrame:
        """One row per provided unit: its first row and the path that the rows amount to.

        That is the first path that is set, or else the last one. Stored, since all tables and the
        new ids are worked out from it.
        """
        path_set = ~ex.is_unset(F.col("media_path"), self._default)
        return freeze(
            self._judged.where("_reason IS NULL")
            .groupBy(*_MATCH)
            .agg(
                F.min("_stored_id").alias("_stored_id"),
                F.min(F.struct(self._order, "preferred_id", *self._values)).alias("r"),
                F.min_by("media_path", F.when(path_set, F.col(self._order))).alias("_set_path"),
                F.max_by("media_path", self._order).alias("_last_path"),
            )
            .select(
                *_MATCH, "_stored_id", "r.*",
                F.coalesce("_set_path", "_last_path").alias("_offered_path"),
            )
        )

    @cached_property
    def _known(self) -> DataFrame:
        """Offers for stored units, with the stored id."""
        return self._offers.where("_stored_id IS NOT NULL").withColumnRenamed("_stored_id", "unit_id")

    @cached_property
    def _added(self) -> DataFrame:
        """Offers for new units, with the id that each one gets."""
        fresh = self._offers.where("_stored_id IS NULL").drop("_stored_id")
        # Of the rows that prefer one id the first may have it, unless a stored unit has it.
        free = (
            fresh.groupBy("preferred_id")
            .agg(F.min(self._order).alias("_holder"))
            .join(
                self._all_ids.select(F.col("unit_id").alias("preferred_id")),
                "preferred_id",
                "left_anti",
            )
        )
        kept = F.when(F.col("_holder") == F.col(self._order), F.col("preferred_id"))
        placed = freeze(
            fresh.join(free, "preferred_id", "left")
            .withColumn("unit_id", kept.cast("bigint"))
            .drop("_holder")
        )
        granted = placed.where(F.col("unit_id").isNotNull())
        top = highest(self._all_ids.union(granted.select("unit_id")), "unit_id")
        moved = number_rows(
            placed.where(F.col("unit_id").isNull()).drop("unit_id"), [self._order], "unit_id"
        ).withColumn("unit_id", F.col("unit_id") + F.lit(top))
        return granted.unionByName(moved)

    @cached_property
    def _offered(self) -> DataFrame:
        columns = ("unit_id", self._order, *self._values)
        return self._known.select(*columns).unionByName(self._added.select(*columns))

    @cached_property
    def unit(self) -> DataFrame:
        filled = F.when(
            F.col("_known") & ex.is_unset(F.col("media_path"), self._default),
            F.col("_offered_path"),
        ).otherwise(F.col("media_path"))
        updates = self._known.select("unit_id", "_offered_path", F.lit(True).alias("_known"))
        new = self._added.withColumn("media_path", F.col("_offered_path"))
        return (
            self._units.join(updates, "unit_id", "left")
            .withColumn("media_path", filled)
            .select(*self._units.columns)
            .unionByName(new.select(*self._units.columns))
        )

    @cached_property
    def spec(self) -> DataFrame:
        present = self._specs.select("unit_id").distinct()
        missing = self._offered.join(present, "unit_id", "left_anti")
        return self._specs.unionByName(missing.select(*self._specs.columns))

    @cached_property
    def munition(self) -> DataFrame:
        shown = self._munitions.where("is_representative").select("unit_id").distinct()
        missing = self._offered.join(shown, "unit_id", "left_anti")
        top = highest(self._all_shots, "munition_id")
        new = number_rows(missing, [self._order], "_n").select(
            (F.col("_n") + F.lit(top)).alias("munition_id"),
            "unit_id",
            F.col("munition_name").alias("name"),
            F.col("munition_kind").alias("kind"),
            "pen",
            F.lit(True).alias("is_representative"),
        )
        return self._munitions.unionByName(new.select(*self._munitions.columns))


def refresh(
    stored: Mapping[str, DataFrame],
    provided: Mapping[str, DataFrame],
    paths: DataFrame,
    default: str = fv.DEFAULT_MEDIA_PATH,
) -> dict[str, DataFrame]:
    """The whole reference load: nations and categories, then units, then media paths.

    ``stored`` and ``provided`` hold nation, category and unit (provided: wide rows), ``stored``
    also spec and munition; provided rows carry their ``position``. ``paths`` lists media by name.
    """
    nations = sync_dims(stored["nation"], provided["nation"], "nation_id").table
    categories = sync_dims(stored["category"], provided["category"], "category_id").table
    units = UnitSync(
        stored["unit"], stored["spec"], stored["munition"], provided["unit"], nations, categories,
        default,
    )
    return {
        "nation": nations,
        "category": categories,
        "unit": media_backfill(units.unit, paths, default),
        "spec": units.spec,
        "munition": units.munition,
    }
