"""Slot changes as a stream: every micro-batch is one exact replay onto the stored slots.

Below ``target``, ``slots/version=N/bucket=B`` holds all slots of each roster that version N
touched, and ``log/version=N/bucket=B`` the outcome of its changes; a roster's slots are those of its
newest version. Version 0 is the start. Micro-batch ``b`` reads the versions up to ``b``, only the
buckets its rosters fall in, and writes version ``b + 1``. A batch that is run again after a
failure reads the same versions and overwrites its own, so a retry changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterlab.operators.replay import apply_slot_changes
from rosterlab.plans.durable import freeze

_SLOT = ("roster_id", "unit_id", "slot_no", "role_note")
_STAMP = "struct<change_ts: timestamp_ntz, change_id: bigint>"
_STORED = (
    "roster_id bigint, unit_id bigint, slot_no int, role_note string, "
    f"changed {_STAMP}, version int, bucket int"
)

_LOGGED = (
    "change_id bigint, roster_id bigint, slot_no int, unit_id bigint, verdict string, "
    "change_ts timestamp_ntz, version int, bucket int"
)


def _newest(slots: DataFrame) -> DataFrame:
    """Of every roster, the rows of its newest version."""
    version = slots.groupBy("roster_id").agg(F.max("version").alias("version"))
    return slots.join(version, ["roster_id", "version"], "left_semi")


@dataclass(frozen=True)
class SlotFeed:
    """A feed into ``target``, checked against these tables.

    Every version spreads its rosters over ``buckets`` folders; the number stays the same for the
    life of a target. Size it so that a bucket of version 0 is a few hundred megabytes.
    """

    target: str
    rosters: DataFrame
    units: DataFrame
    nations: DataFrame
    categories: DataFrame
    buckets: int = 256

    def _path(self, table: str) -> str:
        return f"{self.target.rstrip('/')}/{table}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("roster_id"), F.lit(self.buckets)).cast("int")

    def _write_slots(self, slots: DataFrame, version: int) -> None:
        """One file per bucket where they are small; a bucket that is large is split."""
        slots.select(*_SLOT, "changed", self._bucket().alias("bucket")).hint(
            "rebalance", "bucket"
        ).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self._path('slots')}/version={version}"
        )

    def _read_slots(self) -> DataFrame:
        spark = self.rosters.sparkSession
        return spark.read.schema(_STORED).parquet(self._path("slots"))

    def _write_log(self, log: DataFrame, version: int) -> None:
        log.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode(
            "overwrite"
        ).partitionBy("bucket").parquet(f"{self._path('log')}/version={version}")

    def _read_log(self) -> DataFrame:
        return self.rosters.sparkSession.read.schema(_LOGGED).parquet(self._path("log"))

    def start(self, slots: DataFrame) -> None:
        """Write version 0: the slots before the first change, none of them changed yet."""
        self._write_slots(slots.withColumn("changed", F.lit(None).cast(_STAMP)), 0)
        nothing = self.rosters.sparkSession.createDataFrame([], _LOGGED)
        self._write_log(nothing.drop("version", "bucket"), 0)

    def compact(self, into: SlotFeed) -> None:
        """Write the present slots and the log as version 0 of another feed, which goes on from there."""
        into._write_slots(_newest(self._read_slots()), 0)
        into._write_log(self._read_log().drop("version", "bucket"), 0)

    def slots(self) -> DataFrame:
        """The slots of all rosters as they are now."""
        return _newest(self._read_slots()).select(*_SLOT)

    def log(self) -> DataFrame:
        """Outcome of every change so far, with the version that it led to.

        What a compaction brought along, as version 0, only tells repeats and is not shown.
        """
        return self._read_log().where("version > 0").drop("bucket")

    def apply_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Replay one micro-batch. A change older than the last one of its slot is ``stale``.

        A change whose id is in the log already, whatever its outcome was, is dropped: it counts
        once however often and however late it is delivered. ``batch`` must be stored rows (see
        ``freeze``), as it is read several times.
        """
        # At most ``buckets`` small numbers reach the driver; they prune the folders to read.
        found = batch.select(self._bucket().alias("b")).distinct().collect()
        earlier = (F.col("version") <= batch_id) & F.col("bucket").isin([row["b"] for row in found])
        known = self._read_log().where(earlier).select("change_id")
        batch = freeze(
            batch.dropDuplicates(["change_id"]).join(known, "change_id", "left_anti")
        )
        touched = batch.select("roster_id").distinct()
        before = freeze(
            _newest(
                self._read_slots().where(earlier).join(touched, "roster_id", "left_semi")
            ).select(*_SLOT, "changed")
        )
        stamps = before.where("changed IS NOT NULL").groupBy("roster_id", "slot_no").agg(
            F.max("changed").alias("changed")
        )
        is_stale = F.coalesce(F.struct("change_ts", "change_id") <= F.col("changed"), F.lit(False))
        changes = freeze(
            batch.join(stamps, ["roster_id", "slot_no"], "left")
            .withColumn("is_stale", is_stale)
            .drop("changed")
        )
        fresh = changes.where("NOT is_stale").drop("is_stale")
        replay = apply_slot_changes(
            before.select(*_SLOT), fresh, self.rosters, self.units, self.nations,
            self.categories, store=True,
        )
        stale = changes.where("is_stale").select(
            "change_id", "roster_id", "slot_no", "unit_id", "change_ts",
            F.lit("stale").alias("verdict"),
        )
        log = replay.log.join(fresh.select("change_id", "change_ts"), "change_id").unionByName(stale)
        newest = (
            log.where(F.col("verdict").isin("add", "replace"))
            .groupBy("roster_id", "slot_no")
            .agg(F.max(F.struct("change_ts", "change_id")).alias("_new"))
        )
        after = (
            replay.slots.join(newest, ["roster_id", "slot_no"], "left")
            .join(stamps, ["roster_id", "slot_no"], "left")
            .withColumn("changed", F.coalesce("_new", "changed").cast(_STAMP))
        )
        self._write_log(log, batch_id + 1)
        self._write_slots(after, batch_id + 1)

    def run(
        self, changes: DataFrame, checkpoint: str, repeat_window: str = "1 day"
    ) -> StreamingQuery:
        """Start the feed over a streaming ``changes`` and process everything available.

        A change delivered again within ``repeat_window`` is dropped before it reaches a batch, one
        that comes later by the log: the window changes the cost, not the result. The watermark is
        on the time of arrival, not on ``change_ts``, so no late change is lost.
        """
        once = (
            changes.withColumn("arrived_at", F.current_timestamp())
            .withWatermark("arrived_at", repeat_window)
            .dropDuplicatesWithinWatermark(["change_id"])
            .drop("arrived_at")
        )
        return (
            once.writeStream.foreachBatch(
                lambda batch, batch_id: self.apply_batch(freeze(batch), batch_id)
            )
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
