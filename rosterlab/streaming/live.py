"""Slots kept as the state of a stream, packed by chunks of rosters.

Every roster's slots, the stamp of each slot's last change and the ids of the changes seen are
state of a keyed operator. Its keys are parts of the rosters by hash, and a part's rosters lie in chunks, each one entry,
since a call into Python for each roster, and one into the state for each change id, take longer than all of
their changes. The slots before the feed are packed a chunk at a time and stay so; a roster moves from there to the chunk's
live rosters when its first change comes. Changes (placements and removals, see ``operators/mixed.py``) are checked
against the tables by stream-static joins, meet their roster's state and are applied in
(change_ts, change_id) order of their micro-batch; their outcomes are logged once: each micro-batch writes a version of its own, which
a batch that is run again replaces.
A micro-batch costs its changes and the chunks that they touch, however many
rosters there are. The present slots are read from the state of the last finished batch.

What a task holds is one chunk's rosters and its part's changes of one micro-batch, which the source's
rate limit (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bounds. The log also tells which units left
at each change, so figures of rosters can follow from it (``operators/figures.py``). State lives in RocksDB on the
executors and in the checkpoint folder, from which a lost executor's part is loaded again.
"""

from __future__ import annotations

import itertools
import json
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rosterlab.operators.changes import static_reason
from rosterlab.operators.figures import FigureLog
from rosterlab.operators.mixed import PLACE, REMOVE_SLOT, REMOVE_UNIT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_SLOT = ("roster_id", "unit_id", "slot_no", "role_note")
_LOG = "change_id bigint, roster_id bigint, slot_no int, unit_id bigint, kind string, verdict string"
_STORED = f"{_LOG}, left_units array<bigint>"
# Entries of the state are JSON texts, which neither side has to take apart value by value.
_PACKED = "struct<roster_id: array<bigint>, slot_no: array<int>, unit_id: array<bigint>, role_note: array<string>>"
_LIVE = (
    "array<struct<known: boolean, roster_id: bigint, slot_nos: array<int>, unit_ids: array<array<bigint>>, "
    "notes: array<array<string>>>>"
)
# Entries that are sent on together.
_PACKED_BYTES = 1 << 20
# Ids of changes in an entry, on average at most.
_IDS = 1024
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', change_ts)"
# A stored slot without a number is a place of its own; a state key cannot be null.
_NO_NUMBER = -(1 << 31)


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _text(held) -> str:
    return json.dumps(held, separators=(",", ":"))


class RosterState:
    """One roster's slots: number → (units, notes, stamp of the last change or None)."""

    def __init__(self, slots: dict[int, tuple[list, list, tuple | None]]) -> None:
        self.slots = slots
        self.touched: set[int] = set()
        self.left: list = []  # units that the last change took out

    def _put(self, slot_no: int, units: list, notes: list, stamp: tuple) -> None:
        before = [u for u in self.slots.get(slot_no, ([], [], None))[0] if u is not None]
        if len(before) > 1:
            self.left += (Counter(before) - Counter(units)).elements()
        elif before and before[0] not in units:
            self.left += before
        self.slots[slot_no] = (units, notes, stamp)
        self.touched.add(slot_no)

    def _newer(self, slot_no: int, stamp: tuple) -> bool:
        last = self.slots.get(slot_no, (None, None, None))[2]
        return last is not None and last >= stamp

    def apply(self, kind: str | None, slot_no: int | None, unit_id: int | None, stamp: tuple) -> str:
        """Verdict of a change that no table refuses; older than its slot's last change, it is ``stale``.

        ``left`` then has the units that it took out. A placed unit that was in its slot before did
        not come: the verdict is ``replace``, and ``left`` has it if it is to count as new.
        """
        self.left = []
        if kind == REMOVE_UNIT:
            holds = [s for s, (units, _, _) in self.slots.items() if unit_id in units]
            free = [s for s in holds if not self._newer(s, stamp)]
            for s in free:
                units, notes, _ = self.slots[s]
                stay = [i for i, u in enumerate(units) if u != unit_id]
                self._put(s, [units[i] for i in stay], [notes[i] for i in stay], stamp)
            return "stale" if holds and not free else "remove"
        if slot_no is not None and self._newer(slot_no, stamp):
            return "stale"
        if kind == REMOVE_SLOT:
            if slot_no is not None:
                self._put(slot_no, [], [], stamp)
            return "remove"
        here = list(self.slots.get(slot_no, ([], [], None))[0])
        if unit_id not in here and any(unit_id in units for units, _, _ in self.slots.values()):
            return "already_placed"
        self._put(slot_no, [unit_id], [""], stamp)
        if unit_id in here:
            self.left.append(unit_id)
        return "replace" if here else "add"


class ChangeIds:
    """The ids seen of one roster: with its slots while they are few, then in blocks by the leading bits of a hash.

    ``blocks`` is state by (*key, bits, block).
    """

    def __init__(self, blocks, key: tuple, ids: list[int], bits: int, count: int) -> None:
        self.blocks, self.key, self.ids, self.bits, self.count = blocks, key, ids, bits, count

    def _block(self, change_id: int) -> int:
        return (change_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)

    def _load(self, bits: int, block: int) -> list[int]:
        if not bits:
            return self.ids
        found = self.blocks.getValue((*self.key, bits, block))
        return [] if found is None else array("q", bytes(found[0])).tolist()

    def _store(self, block: int, ids: list[int]) -> None:
        if self.bits:
            self.blocks.updateValue((*self.key, self.bits, block), (array("q", ids).tobytes(),))
        else:
            self.ids = ids

    def take(self, ids: list[int]) -> list[bool]:
        """Which of ``ids`` come for the first time; all of them are known afterwards."""
        first = [False] * len(ids)
        by_block = defaultdict(list)
        for i, change_id in enumerate(ids):
            by_block[self._block(change_id)].append(i)
        for block, places in by_block.items():
            known = self._load(self.bits, block)
            have, more = set(known), []
            for i in places:
                if ids[i] not in have:
                    have.add(ids[i])
                    more.append(ids[i])
                    first[i] = True
            if more:
                self._store(block, known + more)
                self.count += len(more)
        if self.count > _IDS << self.bits:
            self._spread()
        return first

    def _spread(self) -> None:
        before = self.bits
        while self.count > _IDS << self.bits:
            self.bits += 1
        for block in range(1 << before):
            ids = self._load(before, block)
            dealt = defaultdict(list)
            for change_id in ids:
                dealt[self._block(change_id)].append(change_id)
            for into, some in dealt.items():
                self._store(into, some)
            if before and ids:
                self.blocks.removeKey((*self.key, before, block))
        self.ids = []


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        # Each chunk's rosters without changes so far, and those with some.
        self.start = handle.getMapState("start", "chunk bigint", "held string")
        self.held = handle.getMapState("slots", "chunk bigint", "held string")
        # Changes of no roster have none that is known.
        key = "chunk bigint, known boolean, roster_id bigint, bits int, block bigint"
        self.seen = handle.getMapState("seen", key, "ids binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for chunk, held in zip(initialState["chunk"], initialState["held"], strict=True):
            self.start.updateValue((int(chunk),), (held,))

    def _started(self, chunk: int, rosters: set[int]) -> dict[int, dict[int, tuple[list, list, None]]]:
        """Slots before the feed of these rosters, which leave the chunk's start."""
        found = self.start.getValue((chunk,))
        packed = json.loads(found[0]) if found else {"roster_id": []}
        moved = [roster_id in rosters for roster_id in packed["roster_id"]]
        started: dict[int, dict[int, tuple[list, list, None]]] = {}
        if not any(moved):
            return started
        for roster_id, slot_no, unit_id, note in itertools.compress(zip(*packed.values(), strict=True), moved):
            units, notes, _ = started.setdefault(roster_id, {}).setdefault(slot_no, ([], [], None))
            units.append(unit_id)
            notes.append(note)
        if all(moved):
            self.start.removeKey((chunk,))
        else:
            rest = {name: [v for v, m in zip(values, moved, strict=True) if not m] for name, values in packed.items()}
            self.start.updateValue((chunk,), (_text(rest),))
        return started

    def _record(self, known: bool, roster_id: int, slots: dict[int, tuple[list, list, tuple | None]], ids: ChangeIds) -> dict:
        stamps = [stamp or (None, None) for _, _, stamp in slots.values()]
        return {
            "known": known, "roster_id": roster_id, "slot_nos": list(slots),
            "unit_ids": [units for units, _, _ in slots.values()], "notes": [notes for _, notes, _ in slots.values()],
            "changed_us": [us for us, _ in stamps], "changed_ids": [number for _, number in stamps],
            "ids": ids.ids, "bits": ids.bits, "count": ids.count,
        }

    def _apply(self, chunk: int, changes: list) -> Iterator[tuple]:
        """Log of a chunk's changes, which are in the order of rosters and, for each, of time."""
        found = self.held.getValue((chunk,))
        records = {(r["known"], r["roster_id"]): r for r in json.loads(found[0])} if found else {}
        fresh = {row.roster_id for row in changes if row.known and (True, row.roster_id) not in records}
        started = self._started(chunk, fresh) if fresh else {}
        anything = False
        for key, group in itertools.groupby(changes, key=lambda row: (row.known, row.roster_id)):
            known, roster_id = key
            record, own = records.get(key), list(group)
            ids = ChangeIds(self.seen, (chunk, *key), *([record[c] for c in ("ids", "bits", "count")] if record else [[], 0, 0]))
            first = ids.take([row.change_id for row in own])
            if record and not any(first):
                continue
            slots = started.get(roster_id, {}) if known else {}
            if record:
                columns = [record[c] for c in ("slot_nos", "unit_ids", "notes", "changed_us", "changed_ids")]
                slots = {s: (u, n, None if us is None else (us, i)) for s, u, n, us, i in zip(*columns, strict=True)}
            state = RosterState(slots)
            for row in itertools.compress(own, first):
                unit_id = None if row.no_unit else row.unit_id
                slot_no = _whole(row.slot_no)
                if not known:
                    state = RosterState({})
                verdict = row.reason or state.apply(row.kind, slot_no, unit_id, (row.changed_us, row.change_id))
                left = [] if row.reason else state.left
                yield row.change_id, roster_id if known else None, slot_no, unit_id, row.kind, verdict, left
            records[key] = self._record(known, roster_id, state.slots if known else {}, ids)
            anything = True
        if anything:
            self.held.updateValue((chunk,), (_text(list(records.values())),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = ["chunk", "known", "roster_id", "changed_us", "change_id", "no_unit", "unit_id", "slot_no", "kind"]
        changes = pd.concat(list(rows)).sort_values(order)
        log: list[tuple] = []
        for chunk, here in itertools.groupby(changes.itertuples(index=False), key=lambda row: row.chunk):
            log += self._apply(chunk, list(here))
        # Numbers beside nulls would go through floats.
        kinds = {"bigint": "Int64", "int": "Int32", "string": object, "array<bigint>": object}
        names = [c.split() for c in _STORED.split(", ")]
        columns = zip(*log, strict=True) if log else [()] * len(names)
        yield pd.DataFrame({n: pd.Series(list(v), dtype=kinds[k]) for (n, k), v in zip(names, columns, strict=True)})

    def close(self) -> None:
        pass


def _values(column: pa.Array) -> list:
    # Several times as fast as to_pylist(), which takes the values one by one; nulls would make numbers floats.
    plain = pa.types.is_integer(column.type) and column.null_count
    return column.to_pylist() if plain else column.to_numpy(zero_copy_only=False).tolist()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots in the order of chunks become one row a chunk."""
    last, held, done, size = None, {}, [], 0

    def together() -> pa.RecordBatch:
        chunks, texts = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(texts, pa.string())], names=["chunk", "held"])

    for batch in batches:
        chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        values = {name: _values(batch.column(name)) for name in batch.schema.names if name != "chunk"}
        for low, high in itertools.pairwise(edges):
            if low < high and chunks[low] != last:
                if last is not None:
                    done.append((last, _text(held)))
                    size += len(done[-1][1])
                last, held = int(chunks[low]), {name: [] for name in values}
            for name, column in values.items():
                held[name] += column[low:high]
        if size > _PACKED_BYTES:
            yield together()
            done, size = [], 0
    if last is not None:
        done.append((last, _text(held)))
        yield together()


@dataclass(frozen=True)
class LiveSlots:
    """A feed into ``target``, checked against these tables; ``start`` holds the slots before it.

    ``parts`` and ``chunks``, the entries that a part's rosters share, stay the same for the life of a target.
    There should be some parts for each task, and the changes of a part in one micro-batch should fit in a worker.
    """

    target: str
    start: DataFrame
    rosters: DataFrame
    units: DataFrame
    nations: DataFrame
    categories: DataFrame
    parts: int = 1024
    chunks: int = 16

    @property
    def _progress(self) -> str:
        return f"{self.target.rstrip('/')}/progress"

    @property
    def _log(self) -> str:
        return f"{self.target.rstrip('/')}/log"

    def _chunk(self, number: Column) -> Column:
        return F.pmod(F.xxhash64(number), F.lit(self.parts * self.chunks)).cast("bigint").alias("chunk")

    def _part(self) -> Column:
        return F.floor(F.col("chunk") / self.chunks).cast("int").alias("part")

    def outcomes(self, changes: DataFrame) -> DataFrame:
        """Streaming log of a stream of changes (change_id, change_ts, roster_id, slot_no, unit_id, kind).

        A change whose id its roster has seen is dropped, however late it comes again. Changes
        without id or time have no place in an order and are left out.
        """
        whole = changes.where("change_id IS NOT NULL AND change_ts IS NOT NULL")
        judged = static_reason(whole, self.rosters, self.units, self.nations, self.categories)
        known = F.coalesce(F.col("kind").isin(PLACE, REMOVE_UNIT, REMOVE_SLOT), F.lit(False))
        reason = F.when(~known, "kind_unknown").when(F.col("kind") == PLACE, F.col("reason"))
        roster_id, unit_id = (F.col(c).cast("bigint") for c in ("roster_id", "unit_id"))
        change_id, nothing = F.col("change_id").cast("bigint"), F.lit(0).cast("bigint")
        # Null numbers would make those beside them floats in pandas.
        rows = judged.select(
            change_id.alias("change_id"),
            F.expr(_MICROS).alias("changed_us"),
            roster_id.isNotNull().alias("known"),
            F.coalesce(roster_id, nothing).alias("roster_id"),
            F.col("slot_no").cast("int").alias("slot_no"),
            unit_id.isNull().alias("no_unit"),
            F.coalesce(unit_id, nothing).alias("unit_id"),
            "kind",
            reason.alias("reason"),
            # Changes of no roster are refused; many of them are no large group.
            self._chunk(F.coalesce(roster_id, change_id)),
        ).select("*", self._part())
        before = (
            self.start.where("roster_id IS NOT NULL")
            .select(
                self._chunk(roster_id),
                roster_id.alias("roster_id"),
                F.coalesce(F.col("slot_no").cast("int"), F.lit(_NO_NUMBER)).alias("slot_no"),
                F.col("unit_id").cast("bigint").alias("unit_id"),
                "role_note",
            )
            .repartition("chunk")
            .sortWithinPartitions("chunk")
            .mapInArrow(_pack, "chunk bigint, held string")
            .select("chunk", "held", self._part())
        )
        return rows.groupBy("part").transformWithStateInPandas(
            _Processor(),
            outputStructType=_STORED,
            outputMode="Append",
            timeMode="None",
            initialState=before.groupBy("part"),
        )

    def run(self, changes: DataFrame, figures: FigureLog | None = None) -> StreamingQuery:
        """Start the feed over a streaming ``changes`` and process everything available.

        ``figures``, started with the same slots, are brought up to date with every micro-batch.
        """
        changes.sparkSession.conf.set(PROVIDER, ROCKSDB)

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self._log}/version={batch_id}")
            if figures:
                figures.add(self.moves().where(F.col("version") == batch_id), batch_id + 1)

        return (
            self.outcomes(changes)
            .writeStream.foreachBatch(write)
            .option("checkpointLocation", self._progress)
            .trigger(availableNow=True)
            .start()
        )

    def _read_log(self) -> DataFrame:
        return self.start.sparkSession.read.schema(f"{_STORED}, version int").parquet(self._log)

    def log(self) -> DataFrame:
        """Outcome of every change so far."""
        return self._read_log().drop("left_units", "version")

    def moves(self) -> DataFrame:
        """(roster_id, unit_id, weight, version): units that came (1) and left (-1) by each change."""
        stored = self._read_log()
        came = stored.where(F.col("verdict").isin("add", "replace"))
        left = stored.select("roster_id", F.explode("left_units").alias("unit_id"), "version")
        return came.select("roster_id", "unit_id", F.lit(1).alias("weight"), "version").union(
            left.select("roster_id", "unit_id", F.lit(-1).alias("weight"), "version")
        )

    def _state(self, name: str, kind: str) -> DataFrame:
        stored = self.start.sparkSession.read.format("statestore").option("path", self._progress)
        return stored.option("stateVarName", name).load().select(F.from_json("user_map_value.held", kind).alias("held"))

    def slots(self) -> DataFrame:
        """The slots of all rosters after the last finished batch."""
        number = F.when(F.col("slot_no") != _NO_NUMBER, F.col("slot_no")).alias("slot_no")
        before = self._state("start", _PACKED).select(
            F.explode(F.arrays_zip(*[F.col("held")[c].alias(c) for c in _SLOT])).alias("slot")
        )
        live = (
            self._state("slots", _LIVE)
            .select(F.explode("held").alias("held"))
            .where("held.known")
            .select("held.roster_id", F.explode(F.arrays_zip("held.slot_nos", "held.unit_ids", "held.notes")).alias("slot"))
            .select(
                "roster_id",
                F.col("slot")["slot_nos"].alias("slot_no"),
                F.explode(F.arrays_zip("slot.unit_ids", "slot.notes")).alias("held"),
            )
            .select("roster_id", F.col("held")["unit_ids"].alias("unit_id"), "slot_no", F.col("held")["notes"].alias("role_note"))
        )
        return before.select("slot.*").select(*_SLOT).unionByName(live).withColumn("slot_no", number)
