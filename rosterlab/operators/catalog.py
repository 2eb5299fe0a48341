"""Catalogue lists, search and detail."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlab.functions import expressions as ex
from rosterlab.functions import fixed_values as fv

Labels = Mapping[str, str]


def nation_names(nations: DataFrame, as_column: str, labels: Labels) -> DataFrame:
    """Nation id and its label, the side every other operator joins to."""
    return nations.select("nation_id", ex.relabel(F.col("name"), labels).alias(as_column))


def category_names(categories: DataFrame, as_column: str, labels: Labels) -> DataFrame:
    return categories.select("category_id", ex.relabel(F.col("name"), labels).alias(as_column))


def label_normalise(df: DataFrame, column: str, labels: Labels) -> DataFrame:
    return df.withColumn(column, ex.relabel(F.col(column), labels))


def nation_list(nations: DataFrame, labels: Labels = fv.NATION_LABELS) -> DataFrame:
    """Nations sorted by label."""
    return nations.select(
        "nation_id", ex.relabel(F.col("name"), labels).alias("name"), "flag_path"
    ).orderBy(F.col("name").asc_nulls_last(), "nation_id")


def category_list(categories: DataFrame, labels: Labels = fv.CATEGORY_LABELS) -> DataFrame:
    """Categories in id order."""
    return categories.select(
        "category_id", ex.relabel(F.col("name"), labels).alias("name"), "description"
    ).orderBy(F.col("category_id").asc_nulls_last())


def picklist(df: DataFrame, key: str, label: str, all_label: str | None = None) -> DataFrame:
    """(position, key, label) rows for a choice; the blank-key row for "all" comes first."""
    options = df.select(
        F.lit(1).alias("position"),
        F.col(key).cast("string").alias("key"),
        F.col(label).cast("string").alias("label"),
    )
    if all_label:
        everything = df.sparkSession.range(1).select(
            F.lit(0).alias("position"), F.lit("").alias("key"), F.lit(all_label).alias("label")
        )
        options = everything.unionByName(options)
    return options


def search_condition(
    nation_id=None,
    category_id=None,
    rating_min: float | None = None,
    rating_max: float | None = None,
    keyword: str | None = None,
) -> Column | None:
    """AND of the filters that were given.

    Ids and keyword are skipped when empty or zero, bounds only when None.
    """
    given = []
    if nation_id:
        given.append(F.col("nation_id") == F.lit(nation_id))
    if category_id:
        given.append(F.col("category_id") == F.lit(category_id))
    if rating_min is not None:
        given.append(F.col("rating") >= F.lit(float(rating_min)))
    if rating_max is not None:
        given.append(F.col("rating") <= F.lit(float(rating_max)))
    if keyword:
        given.append(ex.contains_ci(F.col("name"), keyword))
    return reduce(lambda left, right: left & right, given) if given else None


def unit_search(
    units: DataFrame,
    nations: DataFrame,
    categories: DataFrame,
    nation_labels: Labels = fv.NATION_LABELS,
    category_labels: Labels = fv.CATEGORY_LABELS,
    sort: bool = True,
    **filters,
) -> DataFrame:
    """Units that match the filters, with nation and category labels.

    The condition sits directly on the unit scan, so its comparisons reach the files.
    """
    condition = search_condition(**filters)
    hits = units if condition is None else units.where(condition)
    found = (
        hits.join(nation_names(nations, "nation", nation_labels), "nation_id")
        .join(category_names(categories, "category", category_labels), "category_id")
        .select("unit_id", "name", "nation", "category", "tier", "rating", "cost", "media_path")
    )
    if not sort:
        return found
    return found.orderBy(
        *[F.col(c).asc_nulls_last() for c in ("nation", "rating", "name", "unit_id")]
    )


def known_units(units: DataFrame, nations: DataFrame, categories: DataFrame) -> DataFrame:
    """Units whose nation and category exist; no other unit is ever shown or placed."""
    return units.join(nations.select("nation_id"), "nation_id", "left_semi").join(
        categories.select("category_id"), "category_id", "left_semi"
    )


def unit_detail(
    units: DataFrame,
    nations: DataFrame,
    categories: DataFrame,
    specs: DataFrame,
    munitions: DataFrame,
    nation_labels: Labels = fv.NATION_LABELS,
    category_labels: Labels = fv.CATEGORY_LABELS,
) -> DataFrame:
    """Every unit with labels, spec and representative munition.

    Units without spec or representative munition stay; a unit with several representative
    munitions has one row for each.
    """
    shown = munitions.where("is_representative").select(
        "unit_id",
        F.col("name").alias("munition_name"),
        F.col("kind").alias("munition_kind"),
        "pen",
    )
    return (
        units.join(nation_names(nations, "nation", nation_labels), "nation_id")
        .join(category_names(categories, "category", category_labels), "category_id")
        .join(specs, "unit_id", "left")
        .join(shown, "unit_id", "left")
        .select(
            *units.columns,
            "nation",
            "category",
            "front",
            "side",
            "rear",
            "munition_name",
            "munition_kind",
            "pen",
        )
    )


def unit_munitions(munitions: DataFrame) -> DataFrame:
    """Munitions of every unit, representative ones first, then by name."""
    return munitions.orderBy(
        F.col("unit_id").asc_nulls_last(),
        F.col("is_representative").desc_nulls_last(),
        F.col("name").asc_nulls_last(),
        F.col("munition_id"),
    )


def dashboard_summary(
    units: DataFrame, nations: DataFrame, categories: DataFrame, rosters: DataFrame
) -> DataFrame:
    """One row: units and rosters that a list would show, nations, title of the newest roster."""
    one = F.count(F.lit(1))
    listed = rosters.join(nations.select("nation_id"), "nation_id", "left_semi")
    newest = F.max_by("title", F.struct("created_at", "roster_id"))
    parts = (
        known_units(units, nations, categories).agg(one.alias("unit_count")),
        listed.agg(one.alias("roster_count"), newest.alias("newest_title")),
        nations.agg(one.alias("nation_count")),
    )
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.agg(
        F.max("unit_count").alias("unit_count"),
        F.max("roster_count").alias("roster_count"),
        F.max("nation_count").alias("nation_count"),
        F.coalesce(F.max("newest_title"), F.lit(fv.NO_VALUE)).alias("newest_title"),
    )
