"""Helpers of the text operators: document keys, stored tables and texts in batches.

A document is known by ``doc_id`` and by a hash of its text, so that rows that share a
``doc_id`` but not the text stay apart, and rows that share both count as one document. A null
``doc_id`` is ordered before all others.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlab.plans.durable import new_folder

KEY, TIE = "_doc_key", "_doc_tie"
KEYS = (KEY, TIE)
BEFORE_ALL = -(1 << 63)


def order_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(BEFORE_ALL))


def keyed(docs: DataFrame, *others: str) -> DataFrame:
    """The key columns, ``text``, and the named columns; whatever else is there is left out."""
    return docs.select(
        *others, "text", order_key().alias(KEY), F.xxhash64(F.col("text")).alias(TIE)
    )


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write the rows to the shared folder and go on with what was written.

    A lost executor then costs a read, and stages that follow do not repeat the work.
    """
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    kept = column.fill_null("") if column.null_count else column
    return kept.cast(pa.large_binary()).to_pylist()


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU libc only


def give_back() -> None:
    """Return freed memory to the machine.

    Python workers outlive their tasks, and what one stage freed but kept would count against the
    executor in all stages after it.
    """
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; the worker gives memory back when a task ends."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def in_slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches at rows so that ``column`` holds some ``most`` bytes, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def document_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Documents of a task in groups of some ``most`` bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in in_slices(batches, "text", most):
        keys = (batch.column(n).to_pylist() for n in KEYS)
        for doc, tie, text in zip(*keys, encoded(batch.column("text")), strict=True):
            held.append((doc, tie, text))
            size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
            give_back()
    if held:
        yield held


def extended(schema: StructType, **types: str) -> StructType:
    """Schema with further columns, given as SQL types."""
    more = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in types.items()))
    return StructType(list(schema.fields) + list(more.fields))


def fold(column: str, parts: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def sampled_keys(
    sizes: DataFrame, by: str, most_rows: int, most_bytes: int, classes: int, every: bool = False
) -> DataFrame:
    """A bounded sample of documents: ``by`` and keys, for a broadcast join with the texts.

    ``sizes`` has ``by``, the keys and ``_n`` (bytes). Per value of ``by``, in an order fixed by a
    hash of the key: at most ``classes`` values of ``by`` (the most frequent), ``most_rows`` rows and
    some ``most_bytes`` bytes each. With ``every`` no value is left out: of more than ``classes``, each
    gets fewer rows and bytes, by the square of the excess, so that a table of all bytes by all classes
    stays as large, but a row at least. Repeated rows count once, in the shares as in the sample. Only
    keys and sizes of candidates meet in the driver: the hash is cut so that some twice as many pass as
    are wanted.
    """
    spark = sizes.sparkSession
    # All copies of a row pass the hash together, so they stand for one.
    sizes = stored(sizes.groupBy(by, KEY, TIE).agg(F.max("_n").alias("_n")), "sizes")
    kind = dict(sizes.dtypes)[by]
    schema = f"`{by}` {kind}, {KEY} bigint, {TIE} bigint"
    counted = (
        sizes.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("b"))
        .orderBy(F.desc("n"), by)
    )
    totals = (counted if every else counted.limit(classes)).collect()
    if not totals:
        return spark.createDataFrame([], schema)
    if len(totals) > classes:
        part = (classes / len(totals)) ** 2
        most_rows, most_bytes = max(1, int(most_rows * part)), max(1, int(most_bytes * part))
    # So many candidates of a value that chance leaves none without one.
    least = 40 if every else 0
    shares = [
        (
            r[0],
            min(
                1.0,
                max(
                    least / r["n"],
                    min(2.0 * max(1, most_rows) / r["n"], 2.0 * max(1, most_bytes) / max(1, r["b"])),
                ),
            ),
        )
        for r in totals
    ]
    limits = spark.createDataFrame(
        [(v, int(s * (1 << 62))) for v, s in shares], f"`{by}` {kind}, _upto bigint"
    )
    order = F.shiftright(F.xxhash64(KEY, TIE, F.lit(by)), 1).bitwiseAND(F.lit((1 << 62) - 1))
    found = (
        sizes.withColumn("_order", order)
        .join(F.broadcast(limits), by)  # a row per class
        .where("_order <= _upto")
        .orderBy("_order", KEY, TIE, by)
        .limit(3 * max(most_rows, least) * len(shares))
        .collect()
    )
    kept: set[tuple] = set()
    held: dict = {}
    for r in found:
        n, b = held.get(r[by], (0, 0))
        if n < most_rows and (n == 0 or b + r["_n"] <= most_bytes):
            held[r[by]] = (n + 1, b + r["_n"])
            kept.add((r[by], r[KEY], r[TIE]))
    return spark.createDataFrame(sorted(kept), schema)


def text_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("_n")
