"""Near-duplicates by SimHash, found by meeting in the middle.

A document's words (runs of anything but the six ASCII blanks, A-Z lower-cased) form shingles of
``shingle`` words, repeats included; fewer words are one shingle, none gives fingerprint zero. A
bit of the fingerprint is set if it is set in over half of the shingles' hashes (XXH64, seed 42).

Two fingerprints at most ``distance`` apart have a word in common that is within half of that of
both. So every different fingerprint emits all words of its ball of that radius, equal words
meet, and the fingerprints that meet are linked in a chain after their distance has been
checked; a chain links what all pairs would. Words are not shuffled one by one: they are dealt
by their leading bits, a fingerprint goes once to each of the few ranges that its ball touches,
and the ball's part in the range is written out there, in blocks cut by the next bits so that
memory stays bounded. The number of ranges follows the number of fingerprints.

Documents with equal fingerprints are one node from the start. A group's id is its smallest
``doc_id``; null ids come first and then give a null group id. Rows that share ``doc_id`` are judged
each by its text. Null text is empty. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import (
    BEFORE_ALL,
    KEY,
    KEYS,
    TIE,
    encoded,
    give_back,
    in_slices,
    keyed,
    lean,
    order_key,
    stored,
)
from rosterlab.llm.graph import components

BITS = 64


@dataclass(frozen=True)
class SimHash:
    shingle: int = 4
    distance: int = 4
    seed: int = 42
    range_words: int = 2_000_000  # words of balls that a range holds on average
    block_words: int = 2_000_000  # and that a task holds at once


def fingerprint(text: bytes, how: SimHash) -> int:
    words = text.lower().split()  # of bytes: ASCII letters and blanks only
    if not words:
        return 0
    n = max(1, len(words) - how.shingle + 1)
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + 1 + b))
    begins = [0] + [e + 1 for e in ends[: n - 1]]
    last = ends[-n:]
    digest, seed = xxhash.xxh64_intdigest, how.seed
    hashes = np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(begins, last, strict=True)), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, how: SimHash) -> DataFrame:
    """doc_id, the document's key and ``print`` (the fingerprint as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 4 << 20):
            found = [fingerprint(t, how) for t in encoded(batch.column("text"))]
            signed = pa.array(np.array(found, np.uint64).view(np.int64))
            names = ["doc_id", *KEYS]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, signed], names=[*names, "print"])

    return keyed(docs, F.col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(
        lean(run), f"doc_id bigint, {KEY} bigint, {TIE} bigint, print bigint"
    )


def flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks over ``bits`` bits with exactly 0, 1, … ``most`` bits set."""
    return [
        np.array([sum(1 << i for i in at) for at in itertools.combinations(range(bits), k)], np.uint64)
        for k in range(most + 1)
    ]


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def meetings(prints: np.ndarray, lead: int, bits: int, how: SimHash) -> np.ndarray:
    """Links among fingerprints whose balls meet in words that begin with ``lead``."""
    radius, masks, out = how.distance // 2, {}, []

    def block(values: np.ndarray, left: np.ndarray, lead: int, bits: int) -> None:
        rest = BITS - bits
        if rest not in masks:
            masks[rest] = flips(rest, radius)
        sizes = [len(m) for m in masks[rest]]
        ball = np.cumsum(sizes)[left]
        if ball.sum() > how.block_words and rest > 4 and len(values) > 1:
            for step in range(16):
                head = lead << 4 | step
                apart = bit_count(values >> np.uint64(rest - 4) & np.uint64(15) ^ np.uint64(step))
                near = apart <= left
                if near.sum() > 1:
                    block(values[near], left[near] - apart[near], head, bits + 4)
            return
        low = values & np.uint64((1 << rest) - 1)
        words, owners = [], []
        for r in range(radius + 1):
            own = np.flatnonzero(left >= r)
            words.append((low[own][:, None] ^ masks[rest][r][None, :]).ravel())
            owners.append(np.repeat(own, sizes[r]))
        word, owner = np.concatenate(words), np.concatenate(owners)
        order = np.lexsort((owner, word))
        word, owner = word[order], owner[order]
        met = np.flatnonzero(word[1:] == word[:-1])
        if len(met):
            pairs = np.unique(owner[met] * len(values) + owner[met + 1])
            a, b = values[pairs // len(values)], values[pairs % len(values)]
            fine = bit_count(a ^ b) <= how.distance
            out.append(np.stack([a[fine], b[fine]], axis=1))

    values = np.unique(prints.view(np.uint64))
    apart = bit_count(values >> np.uint64(BITS - bits) ^ np.uint64(lead))
    near = apart <= radius
    block(values[near], radius - apart[near].astype(np.int64), lead, bits)
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)


def links(prints: DataFrame, how: SimHash) -> DataFrame:
    """Links (``u``, ``v``) among different fingerprints (column ``print``, no repeats)."""
    radius = how.distance // 2
    ball = sum(len(m) for m in flips(BITS, radius))
    n = prints.count()
    bits = min(20, max(4, int(np.ceil(np.log2(max(1, n * ball) / how.range_words + 1)))))
    touched = [int(m) for masks in flips(bits, radius) for m in masks]
    ranges = F.explode(
        F.array(
            *[
                F.shiftrightunsigned("print", BITS - bits).bitwiseXOR(F.lit(m).cast("bigint"))
                for m in touched
            ]
        )
    )

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = meetings(group["print"].to_numpy(np.int64), int(key[0]), bits, how)
        give_back()
        return pd.DataFrame(found.view(np.int64), columns=["u", "v"])

    return (
        prints.select("print", ranges.alias("_range"))
        .groupBy("_range")
        .applyInPandas(meet, "u bigint, v bigint")
        .distinct()
    )


def near_duplicates(docs: DataFrame, how: SimHash | None = None) -> DataFrame:
    """Per document: doc_id, its key, fingerprint (hexadecimal) and component_id."""
    how = how or SimHash()
    marked = stored(fingerprints(docs, how), "prints")
    first = stored(marked.groupBy("print").agg(F.min(KEY).alias("_first")), "different")
    found = components(links(first.select("print"), how))
    # Fingerprints without links are their own component.
    grouped = first.join(found.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "_first", F.coalesce("component", "print").alias("component")
    )
    ids = grouped.groupBy("component").agg(F.min("_first").alias("_id"))
    named = grouped.join(ids, "component").select("print", "_id", "component")
    return marked.join(named, "print").select(
        "doc_id",
        *KEYS,
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("_id") != BEFORE_ALL, F.col("_id")).alias("component_id"),
        F.col("_id").alias("_group"),
        F.col("component").alias("_component"),
    )


def one_of_each(docs: DataFrame, how: SimHash | None = None) -> DataFrame:
    """The first document of each group: all columns of ``docs``, one row a group."""
    found = near_duplicates(docs, how)
    # Of a group's smallest doc_id, the row with the smallest hash of its text.
    least = found.where(f"{KEY} = _group").groupBy("_component", KEY)
    first = least.agg(F.min(TIE).alias(TIE)).select(*KEYS)
    names = docs.columns
    own = docs.select("*", order_key().alias(KEY), F.xxhash64("text").alias(TIE))
    kept = own.join(first, list(KEYS), "left_semi")
    return kept.dropDuplicates(list(KEYS)).select(*names)
