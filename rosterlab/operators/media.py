"""Media paths of catalogue items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlab.functions import expressions as ex
from rosterlab.functions import fixed_values as fv


def media_url(media_id: Column, prefix: str, suffix: str = ".png") -> Column:
    """Address of a hosted picture: prefix, id, suffix."""
    return F.concat(F.lit(prefix), media_id, F.lit(suffix))


def media_enrich(
    items: DataFrame, paths: DataFrame, default: str = fv.DEFAULT_MEDIA_PATH
) -> DataFrame:
    """Give every item the path listed for its name, or the default.

    ``paths`` has one row per name: ``name``, ``path``.
    """
    listed = _one_path(paths)
    kept = [c for c in items.columns if c != "media_path"]
    return items.join(listed, "name", "left").select(
        *kept, F.coalesce("_listed", F.lit(default)).alias("media_path")
    )


def _one_path(paths: DataFrame) -> DataFrame:
    """One path a name, the smallest of several, so that no item is repeated."""
    return paths.groupBy("name").agg(F.min("path").alias("_listed"))


def media_backfill(
    units: DataFrame, paths: DataFrame, default: str = fv.DEFAULT_MEDIA_PATH
) -> DataFrame:
    """Fill paths that are blank or still the default: the one listed for the name, else the default.

    Names are matched whatever the nation; a path that was set is never touched.
    """
    listed = _one_path(paths)
    current = F.col("media_path")
    filled = F.when(
        ex.is_unset(current, default), F.coalesce("_listed", F.lit(default))
    ).otherwise(current)
    return units.join(listed, "name", "left").select(
        *[filled.alias(c) if c == "media_path" else F.col(c) for c in units.columns]
    )


def media_kind(df: DataFrame, column: str) -> DataFrame:
    """Add ``media_kind``: remote, file or none."""
    text = F.lower(ex.strip(F.col(column)))
    remote = F.lit(False)
    for prefix in fv.REMOTE_PREFIXES:
        remote = remote | text.startswith(prefix)
    return df.withColumn(
        "media_kind",
        F.when(ex.is_blank(F.col(column)), "none").when(remote, "remote").otherwise("file"),
    )


def media_resolve(
    items: DataFrame,
    manifest: DataFrame,
    key: str,
    column: str,
    default: str = fv.DEFAULT_MEDIA_PATH,
    folder: str = fv.ASSET_FOLDER,
) -> DataFrame:
    """Picture to show for every item: (key, resolved).

    A remote path stands for itself. Otherwise the first of the path, the path below the
    asset folder (relative paths only) and the default that ``manifest`` lists is taken; NULL
    when none is listed. ``manifest`` holds the stored files in its column ``path``.
    """
    raw = F.coalesce(ex.strip(F.col(column)), F.lit(""))
    base = media_kind(items.select(key, raw.alias("_raw")), "_raw")
    below = F.when(~F.col("_raw").startswith("/"), F.concat(F.lit(folder), F.col("_raw")))
    candidates = F.when(F.col("_raw") != "", F.array(F.col("_raw"), below))
    # Paths repeat from item to item: look each distinct one up once, then hand the answer back.
    asked = base.where(F.col("media_kind") != "remote").select("_raw").distinct()
    ranks = (
        asked.select("_raw", F.posexplode(candidates).alias("_rank", "path"))
        .join(manifest.select("path").distinct(), "path", "left_semi")
        .groupBy("_raw")
        .agg(F.min("_rank").alias("_rank"))
    )
    found = ranks.select("_raw", F.when(F.col("_rank") == 0, F.col("_raw")).otherwise(below).alias("_found"))
    # The default is the same for all: it is looked up once, not once a path.
    fallback = manifest.where(F.col("path") == default).agg(F.max("path")).scalar()
    return base.join(found, "_raw", "left").select(
        key,
        F.when(F.col("media_kind") == "remote", F.col("_raw"))
        .otherwise(F.coalesce("_found", fallback))
        .alias("resolved"),
    )
