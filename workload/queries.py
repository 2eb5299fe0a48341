"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab import schemas
from rosterlab.operators import (
    audit_state,
    availability,
    benchmark,
    catalog,
    changes,
    figures,
    intake,
    media,
    mixed,
    names,
    quality,
    ranges,
    replay,
    roster,
    sync,
)
from rosterlab.plans.durable import freeze, new_folder
from rosterlab.plans.numbering import highest, number_rows
from rosterlab.session import tune
from rosterlab.sources import provider, tables
from rosterlab.streaming import feed, intake_feed, live
from workload.views import CATEGORY_LABELS, GAME_MODES, NATION_LABELS, VIEWS, Inputs

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}

NATIONS = {"nation_labels": NATION_LABELS}
CATEGORIES = {"category_labels": CATEGORY_LABELS}
LABELS = NATIONS | CATEGORIES

# Filters of the registered search: every kind of filter at once.
SEARCH = {
    "nation_id": 7,
    "category_id": "PROMO",
    "rating_min": 901.5,
    "rating_max": 990.5,
    "keyword": "L%_N",
}
MEDIA_HOST = "https://media.invalid/"
CREATED_AT = "2024-06-01 00:00:00"


def query(build: Callable[[Inputs], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Inputs(tune(spark), sf_dir))

    _REGISTERED[build.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


@query
def nation_list(t):
    return catalog.nation_list(t.nations, NATION_LABELS)


@query
def category_list(t):
    return catalog.category_list(t.categories, CATEGORY_LABELS)


@query
def label_normalise(t):
    return catalog.label_normalise(
        t.units.select("unit_id", "category_id"), "category_id", CATEGORY_LABELS
    )


@query
def picklist(t):
    return catalog.picklist(t.rosters, "roster_id", "title", all_label="all")


@query
def unit_search(t):
    return catalog.unit_search(t.units, t.nations, t.categories, **LABELS, **SEARCH)


@query
def unit_search_all(t):
    return catalog.unit_search(t.units, t.nations, t.categories, **LABELS)


@query
def unit_search_indexed(t):
    index = names.NameIndex(new_folder(t.spark, "names"))
    index.build(t.units)
    every = catalog.unit_search(t.units, t.nations, t.categories, **LABELS, sort=False)
    return names.indexed_unit_search(index, t.keywords, every)


@query
def unit_detail(t):
    return catalog.unit_detail(t.units, t.nations, t.categories, t.specs, t.munitions, **LABELS)


@query
def unit_munitions(t):
    return catalog.unit_munitions(t.munitions)


@query
def dashboard_summary(t):
    return catalog.dashboard_summary(t.units, t.nations, t.categories, t.rosters)


@query
def roster_list(t):
    return roster.roster_list(t.rosters, t.nations, **NATIONS)


@query
def roster_list_of_nation(t):
    return roster.roster_list(t.rosters, t.nations, nation_id=7, **NATIONS)


@query
def latest_roster_per_nation(t):
    return roster.latest_roster_per_nation(t.rosters, t.nations)


@query
def roster_slots(t):
    return roster.roster_slots(t.slots)


@query
def roster_detail(t):
    return roster.roster_detail(
        t.rosters, t.nations, t.slot_clean, t.units, t.categories, **LABELS
    )


@query
def roster_summary(t):
    return roster.roster_summary(t.rosters, t.nations, t.slot_clean, t.units, **NATIONS)


@query
def roster_cap_list(t):
    return roster.roster_cap_list(roster_summary(t.spark, t.sf_dir))


@query
def roster_cards(t):
    return roster.roster_cards(roster_summary(t.spark, t.sf_dir))


@query
def roster_cap(t):
    return roster.roster_cap(t.slots, t.units)


@query
def category_counts(t):
    return roster.category_counts(t.rosters, t.slot_clean, t.units, t.categories, **CATEGORIES)


@query
def slot_grid(t):
    return roster.slot_grid(
        t.rosters, t.nations, t.slot_clean, t.units, t.categories, **CATEGORIES
    )


@query
def slot_occupancy(t):
    return roster.slot_occupancy(t.rosters, t.slots)


@query
def available_units(t):
    newest = roster.latest_roster_per_nation(t.rosters, t.nations)
    listed = catalog.unit_search(t.units, t.nations, t.categories, **LABELS, sort=False)
    return roster.available_units(newest, listed, t.units, t.slots)


@query
def available_counts(t):
    return roster.available_counts(
        t.rosters, t.units, t.nations, t.slots, t.categories
    )


def _available_sets(t):
    return availability.available_sets(t.rosters, t.units, t.nations, t.slots, t.categories)


@query
def available_set_counts(t):
    return _available_sets(t).select("roster_id", "available_count")


@query
def available_bitmaps(t):
    newest = roster.latest_roster_per_nation(t.rosters, t.nations).select("roster_id")
    sets = _available_sets(t).join(newest, "roster_id", "left_semi")
    return availability.unfolded(sets, availability.nation_bitmaps(t.units, t.nations, t.categories))


@query
def units_in_use(t):
    return roster.units_in_use(t.stock, t.slots)


@query
def stale_selection(t):
    return roster.stale_selection(t.selections, t.rosters)


@query
def peer_benchmark(t):
    return benchmark.peer_benchmark(t.pairs, t.slots, t.units, t.specs, t.munitions)


@query
def peer_benchmark_long(t):
    return benchmark.peer_benchmark_long(
        benchmark.peer_benchmark(
            t.pairs, t.slots, t.units, t.specs, t.munitions, one_munition=True
        )
    )


@query
def assign_ids(t):
    top = highest(t.units, "unit_id")
    return number_rows(t.orders.select("o_orderkey"), ["o_orderkey"], "n").select(
        "o_orderkey", (F.col("n") + top).alias("new_id")
    )


@query
def media_enrich(t):
    hosted = t.media_paths.select(
        "name", media.media_url(F.col("path"), MEDIA_HOST, suffix="").alias("path")
    )
    return media.media_enrich(t.units.select("unit_id", "name"), hosted)


@query
def media_backfill(t):
    return media.media_backfill(t.units, t.media_paths)


@query
def media_kind(t):
    return media.media_kind(t.page_refs, "path")


@query
def media_resolve(t):
    return media.media_resolve(t.media_refs, t.media_manifest, "unit_id", "media_path")


def _tables(t):
    return {
        "nation": t.nations,
        "category": t.categories,
        "unit": t.units,
        "spec": t.specs,
        "munition": t.munitions,
        "roster": t.rosters,
        "slot": t.slots,
    }


@query
def audit_unique(t):
    return quality.audit_unique(_tables(t))


@query
def audit_unique_keys(t):
    return quality.audit_unique_keys(_tables(t))


@query
def audit_not_null(t):
    return quality.audit_not_null(_tables(t) | {"unit": t.registrations}, {
        **schemas.REQUIRED,
        "unit": ("nation_id", "category_id", "name", "tier", "rating", "cost", "munition_name"),
    })


@query
def audit_check(t):
    registered_units = t.registrations
    return quality.audit_check(
        _tables(t)
        | {
            "unit": registered_units,
            "spec": registered_units,
            "munition": registered_units,
            "slot": t.slot_changes,
        },
        schemas.checks(GAME_MODES),
    )


@query
def audit_fk(t):
    return quality.audit_fk(
        _tables(t) | {"unit": t.registrations.withColumn("unit_id", F.col("request_id")),
                      "slot": t.slot_changes, "spec": t.delete_requests}
    )


def _followed(t, final, kind, **rules):
    """The tables' audit, then change sets that turn them into ``final``, and its report."""
    log = audit_state.AuditLog(new_folder(t.spark, "audit"), **({"keys": (), "references": (), "required": {}} | rules))
    first = _tables(t)
    log.apply({name: audit_state.weighted(came=df) for name, df in first.items()}, 0)
    version = 1
    for name in [n for n in final if final[n] is not first[n]]:
        sets = [{name: audit_state.weighted(final[name], first[name])}]
        # Parents go, and come back.
        sets += [{"nation": audit_state.weighted(went=t.nations)}, {"nation": audit_state.weighted(came=t.nations)}]
        for changes in sets:
            log.apply(changes, version)
            version += 1
    return log.report(t.spark).where(F.col("kind") == kind)


@query
def audit_followed_unique(t):
    tables = _tables(t)
    # The slots without repeats come first and are replaced by all.
    start = tables | {"slot": t.slot_clean}
    log = audit_state.AuditLog(new_folder(t.spark, "audit"), references=(), required={})
    log.apply({name: audit_state.weighted(came=df) for name, df in start.items()}, 0)
    log.apply({"slot": audit_state.weighted(t.slots, t.slot_clean)}, 1)
    return log.report(t.spark).drop("kind")


@query
def audit_followed_fk(t):
    final = _tables(t) | {
        "unit": t.registrations.withColumn("unit_id", F.col("request_id")),
        "slot": t.slot_changes,
        "spec": t.delete_requests,
    }
    return _followed(t, final, audit_state.REFERENCE, references=schemas.REFERENCES).drop("kind")


@query
def audit_followed_checks(t):
    wide = t.registrations
    final = _tables(t) | {"unit": wide, "spec": wide, "munition": wide, "slot": t.slot_changes}
    found = _followed(t, final, audit_state.CHECK, keys=schemas.KEYS[:1], checks=schemas.checks(GAME_MODES))
    return found.drop("kind", "rows_involved")


@query
def intake_validate(t):
    checked = intake.intake_validate(
        t.raw_forms, texts=("name",), ints=("nation_id", "tier", "cost"), floats=("rating",)
    )
    return checked.withColumn("reasons", F.concat_ws(",", "reasons"))


def _registration(t):
    return changes.register_units(
        t.registrations, t.units, t.munitions, t.nations, t.categories
    )


@query
def register_units_accepted(t):
    return _registration(t).accepted


@query
def register_units_rejected(t):
    return _registration(t).rejected


@query
def register_feed(t):
    """The registrations as raw text, in four deliveries by request, the first of them twice."""
    target = new_folder(t.spark, "intake")
    fields = t.registrations.schema
    fed = intake_feed.IntakeFeed(
        f"{target}/out", t.units, t.munitions, t.nations, t.categories, fields,
        ints=("nation_id", "tier", "front", "side", "rear", "pen"),
    )
    fed.start()
    raw = t.registrations.select("request_id", *[F.col(c).cast("string") for c in fields.names if c != "request_id"])
    edges = raw.agg(F.percentile_approx("request_id", [0.25, 0.5, 0.75]).alias("at")).first()["at"]
    place = F.lit(0)
    for edge in edges:
        place = place + (F.col("request_id") > edge).cast("int")
    for part in (0, 1, 2, 3, 0):
        raw.where(place == part).write.mode("append").parquet(f"{target}/inbox")
        fed.run(t.spark.readStream.schema(raw.schema).parquet(f"{target}/inbox"), f"{target}/progress").awaitTermination()
    return fed.table(intake_feed.ACCEPTED).drop("version")


@query
def register_units_tables(t):
    """Row counts and value totals of the three tables after the registration."""
    new = _registration(t).tables()
    return (
        t.units.unionByName(new["unit"])
        .join(t.specs.unionByName(new["spec"]), "unit_id", "left")
        .join(
            t.munitions.unionByName(new["munition"])
            .where("is_representative")
            .select("unit_id", "munition_id", F.col("name").alias("munition_name"), "pen"),
            "unit_id",
            "left",
        )
    )


def _deletion(t):
    return changes.delete_units(
        t.delete_requests, t.stock, t.stock_specs, t.stock_munitions, t.slots
    )


@query
def delete_units_remaining(t):
    return _deletion(t).unit.select("unit_id", "name")


@query
def delete_units_specs(t):
    return _deletion(t).spec


@query
def delete_units_munitions(t):
    return _deletion(t).munition


@query
def delete_units_rejected(t):
    return _deletion(t).rejected


def _creation(t):
    return changes.create_rosters(
        t.roster_requests,
        t.rosters,
        t.nations,
        created_at=F.lit(CREATED_AT).cast("timestamp_ntz"),
        game_modes=GAME_MODES,
    )


@query
def create_rosters(t):
    return _creation(t).created


@query
def create_rosters_rejected(t):
    return _creation(t).rejected


@query
def slot_change_verdicts(t):
    return changes.slot_change_verdicts(
        t.slot_changes, t.slot_clean, t.rosters, t.units, t.nations, t.categories
    )


@query
def slot_change_verdicts_repeats(t):
    """Over slots of which some hold several units."""
    return changes.slot_change_verdicts(
        t.slot_changes, t.slots, t.rosters, t.units, t.nations, t.categories
    )


def _replay(t):
    return replay.apply_slot_changes(
        t.slot_clean, t.slot_changes, t.rosters, t.units, t.nations, t.categories
    )


@query
def apply_slot_changes(t):
    return _replay(t).slots


@query
def apply_slot_changes_log(t):
    return _replay(t).log


def _mixed(t):
    return mixed.apply_mixed_changes(
        t.slot_clean, t.mixed_changes, t.rosters, t.units, t.nations, t.categories
    )


@query
def apply_mixed_changes(t):
    return _mixed(t).slots


@query
def apply_mixed_changes_log(t):
    return _mixed(t).log


@query
def slot_feed(t):
    target = new_folder(t.spark, "slot-feed")
    changed = feed.SlotFeed(target, t.rosters, t.units, t.nations, t.categories, buckets=8)
    changed.start(t.slot_clean)
    # The events arrive as files (the pattern stands for one file or a folder of them); the view
    # then shapes them as it does for the batch queries.
    arriving = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*")
    stream = t.spark.sql(
        VIEWS["slot_changes"], events=arriving, rosters=t.rosters, own_units=t.own_units
    )
    changed.run(stream, f"{target}/progress").awaitTermination()
    return changed.slots()


def _live(t, with_figures=False):
    """The mixed log in four deliveries by time, the first of them twice, each a micro-batch."""
    target = new_folder(t.spark, "live-slots")
    inbox = f"{target}/inbox"
    # What several steps read is worked out once.
    start, log = t.store("slot_clean"), t.store("mixed_changes")
    rosters = freeze(t.rosters.select("roster_id", "nation_id"))
    kept = live.LiveSlots(target, start, rosters, t.units, t.nations, t.categories)
    followed = figures.FigureLog(f"{target}/figures", t.units)
    if with_figures:
        followed.start(start)
    edges = t.spark.sql(
        "SELECT percentile_approx(change_ts, array(0.25, 0.5, 0.75)) AS at FROM {log}", log=log
    ).first()["at"]
    lows, highs = [None, *edges], [*edges, None]
    parts = []
    for low, high in zip(lows, highs, strict=True):
        part = log if low is None else log.where(F.col("change_ts") > F.lit(low))
        parts.append(part if high is None else part.where(F.col("change_ts") <= F.lit(high)))
    for part in (*parts, parts[0]):
        part.write.mode("append").parquet(inbox)
        arriving = t.spark.readStream.schema(log.schema).parquet(inbox)
        kept.run(arriving, followed if with_figures else None).awaitTermination()
    return followed if with_figures else kept


@query
def slot_feed_mixed(t):
    return _live(t).slots()


@query
def slot_feed_mixed_log(t):
    return _live(t).log()


@query
def live_roster_summary(t):
    return _live(t, with_figures=True).summary(t.rosters, t.nations, **NATIONS)


@query
def live_category_counts(t):
    return _live(t, with_figures=True).category_counts(t.rosters, t.categories, **CATEGORIES)


@query
def remove_slots_by_unit(t):
    return changes.remove_slots(t.slots, t.removals)


@query
def remove_slots_by_number(t):
    return changes.remove_slots(t.slots, t.removals, by=("roster_id", "slot_no"))


def _first_load(t, name):
    """A provider's wide rows, as JSON files, become the first rows of an empty store."""
    provider, root = new_folder(t.spark, "provider"), new_folder(t.spark, "store")
    t.wide_units.write.json(provider)
    wide = tables.reference_source(t.spark, provider, "staged_unit", "json")
    tables.seed(t.spark, root, {"nation": t.nations} | changes.split_seed(wide, "unit_id"))
    return tables.read_table(t.spark, root, name)


@query
def first_load_units(t):
    return _first_load(t, "unit")


def _provided_load(t, name):
    """The same first load from a provider behind the data source, a part for each of its files."""
    folder, root = new_folder(t.spark, "provider"), new_folder(t.spark, "store")
    t.wide_units.repartition(4).write.json(f"{folder}/{provider.STAGED}")
    t.nations.write.json(f"{folder}/nation")
    provider.register(t.spark)
    wide, nations = (
        provider.provided(t.spark, table, "rosterlab.sources.provider:LineFiles", path=folder)
        for table in (provider.STAGED, "nation")
    )
    tables.seed(t.spark, root, {"nation": nations} | changes.split_seed(wide, "unit_id"))
    return tables.read_table(t.spark, root, name)


@query
def provider_load_nations(t):
    return _provided_load(t, "nation")


@query
def provider_load_units(t):
    return _provided_load(t, "unit")


@query
def provider_load_munitions(t):
    return _provided_load(t, "munition")


@query
def first_load_specs(t):
    return _first_load(t, "spec")


@query
def first_load_munitions(t):
    return _first_load(t, "munition")


def _owners(t):
    return sync.sync_dims(t.owners, t.provided_owners, "owner_id")


@query
def sync_dims(t):
    return _owners(t).table


@query
def sync_dims_rejected(t):
    return _owners(t).rejected


def _synced(t):
    return sync.UnitSync(
        t.old_units, t.old_specs, t.old_munitions, t.provided_units, t.nations, t.categories
    )


@query
def sync_units(t):
    return _synced(t).unit


@query
def sync_units_specs(t):
    return _synced(t).spec


@query
def sync_units_munitions(t):
    return _synced(t).munition


def _ranged(t):
    """The same sync over ranges, then again: nothing differs, so nothing is read."""
    schemas = {"unit": t.old_units.schema, "spec": t.old_specs.schema, "munition": t.old_munitions.schema}
    store = ranges.RangeStore(t.spark, new_folder(t.spark, "ranged"), schemas, ranges=32)
    store.load(t.old_units, t.old_specs, t.old_munitions)
    provider = ranges.laid_out(t.provided_units, 32)
    store.sync(provider, t.nations, t.categories)
    if store.sync(provider, t.nations, t.categories).ranges:
        raise RuntimeError("equal ranges were read again")
    return store


@query
def sync_ranges_units(t):
    return _ranged(t).table("unit")


@query
def sync_ranges_specs(t):
    return _ranged(t).table("spec")


@query
def sync_ranges_munitions(t):
    return _ranged(t).table("munition")


@query
def sync_units_rejected(t):
    return sync.UnitSync(
        t.old_units, t.old_specs, t.old_munitions, t.faulty_units, t.nations, t.categories
    ).rejected


def _refreshed(t):
    provided = {"nation": t.provided_nations, "category": t.provided_categories, "unit": t.provided_units}
    stored = {
        "nation": t.old_nations,
        "category": t.old_categories,
        "unit": t.old_units,
        "spec": t.old_specs,
        "munition": t.old_munitions,
    }
    named = t.provided_units.groupBy("name").agg(F.max("media_path").alias("path"))
    return sync.refresh(stored, provided, named)


@query
def refresh_nations(t):
    return _refreshed(t)["nation"]


@query
def refresh_categories(t):
    return _refreshed(t)["category"]


@query
def refresh_units(t):
    return _refreshed(t)["unit"]


@query
def refresh_specs(t):
    return _refreshed(t)["spec"]


@query
def refresh_munitions(t):
    return _refreshed(t)["munition"]
