"""Removal of sentences that lie in a repeated run of sentences.

A text is cut into sentences at the full stops of several scripts and at line ends. Long sentences are cut
on at places that depend on their own words only: after a word whose MD5 begins with a byte below
``CUT``, one in six. So a passage that two texts share falls into the same sentences in both,
wherever it begins and whatever surrounds it; only its ends differ. Every run of ``run`` consecutive
sentences is hashed, whatever its length: two sums of 64 bits over the 128-bit hashes of its sentences
(words joined by a space), each multiplied by a factor for its place. A text with fewer sentences is
one run. Runs are joined over all documents, and a sentence is removed,
with the blanks before it, if any run that covers it also starts earlier (in a smaller ``doc_id``, or
earlier in the same document).

Runs that a task meets again in the texts it holds are settled there; one row a task and ``flush_bytes`` is
left of a run however often it occurs, so even a run that a third of all documents share is a small
group when the runs meet by their hash. What is settled travels under a hash of its place.

Null is the empty text. Rows that share ``doc_id`` are ordered by a hash of their text; rows that
share both are one document, and each gets its result. Null ids come first. An empty table gives
no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlab.llm.common import KEY, KEYS, TIE, document_runs, in_slices, keyed, lean

MARKS = ".!?。！？।؟…"
BLANKS = " \t\r\n"
CUT = 43
PIECE = rf"[{BLANKS}]*(?:[^{BLANKS}{MARKS}]+[{MARKS}]*|[{MARKS}]+)"
_pieces = re.compile(PIECE).findall
_mark_inside = re.compile(f"[{MARKS}][^{MARKS}]").search
_KNOWN = 40  # characters of a word that is remembered


@dataclass(frozen=True)
class Spans:
    run: int = 6
    flush_bytes: int = 8 << 20


def ends_sentence(piece: str) -> bool:
    return piece[-1] in MARKS or hashlib.md5(piece.encode()).digest()[0] < CUT


def parted(word: str) -> bool | list[tuple[str, bool]]:
    """Whether what stands between blanks ends a sentence; its pieces where marks lie inside it."""
    if not _mark_inside(word):
        return ends_sentence(word)
    return [(piece, ends_sentence(piece)) for piece in _pieces(word)]


_parted = functools.lru_cache(1 << 16)(parted)


def sentences(text: str) -> list[str]:
    """The words of each sentence, joined by spaces."""
    found: list[str] = []
    words: list[str] = []
    for line in text.replace("\t", " ").replace("\r", " ").split("\n"):
        if words:
            found.append(" ".join(words))
            words = []
        for word in line.split(" "):
            if not word:
                continue
            ends = _parted(word) if len(word) <= _KNOWN else parted(word)
            if ends is False:
                words.append(word)
            elif ends is True:
                words.append(word)
                found.append(" ".join(words))
                words = []
            else:
                for piece, last in ends:
                    words.append(piece)
                    if last:
                        found.append(" ".join(words))
                        words = []
    if words:
        found.append(" ".join(words))
    return found


def without(text: str, drop: set[int]) -> str:
    """The text without the sentences of these numbers and the blanks before them."""
    kept: list[str] = []
    n, at, fresh = -1, 0, True
    for piece in _pieces(text):
        n += fresh or "\n" in piece
        fresh = ends_sentence(piece.lstrip(BLANKS))
        at += len(piece)
        if n not in drop:
            kept.append(piece)
    return "".join(kept) + text[at:]


def run_hashes(digests: np.ndarray, run: int) -> np.ndarray:
    """Hashes (two numbers each) of all runs of ``run`` sentences, or of all sentences if they are fewer."""
    n = len(digests)
    size = min(run, n)
    factors = np.random.default_rng(29).integers(1, 1 << 63, (run + 1, 2), np.uint64) * 2 + 1
    hashes = np.zeros((n - size + 1, 2), np.uint64) + factors[run] * np.uint64(size)
    for k in range(size):
        hashes += digests[k : n - size + 1 + k] * factors[k]
    return hashes


_SPANS = f"a bigint, b bigint, {KEY} bigint, {TIE} bigint, at int, again boolean"


def hashed_spans(docs: DataFrame, how: Spans) -> DataFrame:
    """Runs of the keyed ``docs`` by hash; ``again`` marks those that the task saw earlier, and one row
    for each document, whose ``at`` is -1 less its number of sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in document_runs(batches, how.flush_bytes):
            hashes, keys, numbers, ends = [], [], [], []
            last = None
            for doc, tie, text in sorted(texts):
                if last == (doc, tie):
                    continue  # a repeated row is the same document
                last = doc, tie
                found = sentences(text.decode())
                keys.append((doc, tie))
                ends.append(len(found))
                if found:
                    joined = b"".join(xxhash.xxh3_128_digest(s.encode()) for s in found)
                    hashes.append(run_hashes(np.frombuffer(joined, "<u8").reshape(-1, 2), how.run))
                numbers.append(len(hashes[-1]) if found else 0)
            own = np.array(keys, np.int64).reshape(-1, 2)
            count = np.array(numbers, np.int64)
            runs = np.concatenate(hashes) if hashes else np.zeros((0, 2), np.uint64)
            owner = np.repeat(np.arange(len(own)), count)
            at = np.arange(len(runs)) - np.repeat(np.cumsum(count) - count, count)
            # Documents are in order, so of equal runs the first is the earliest.
            order = np.lexsort((runs[:, 1], runs[:, 0]))
            same = (runs[order[1:]] == runs[order[:-1]]).all(axis=1)
            again = np.zeros(len(runs), bool)
            again[order[1:][same]] = True
            # What is settled travels by a hash of its place.
            place = np.array([KEY_MIX, TIE_MIX], np.uint64) * (own[owner].view(np.uint64) + at[:, None].astype(np.uint64))
            runs[again] = place[again]
            marks = own.view(np.uint64) * np.array([KEY_MIX, TIE_MIX], np.uint64)
            halves = np.concatenate([runs, marks]).view(np.int64)
            columns = [
                *(np.ascontiguousarray(c) for c in halves.T),
                *(np.ascontiguousarray(c) for c in np.concatenate([own[owner], own]).T),
                np.concatenate([at, -1 - np.array(ends, np.int64)]).astype(np.int32),
                np.concatenate([again, np.ones(len(own), bool)]),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["a", "b", KEY, TIE, "at", "again"]
            )

    return docs.mapInArrow(lean(run), _SPANS)


KEY_MIX, TIE_MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def remove_repeats(docs: DataFrame, how: Spans | None = None) -> DataFrame:
    """Per row: doc_id, text without the removed sentences, n_sentences and n_removed."""
    how = how or Spans()
    own = keyed(docs, F.col("doc_id").cast("bigint").alias("doc_id"))
    order = Window.partitionBy("a", "b").orderBy(KEY, TIE, "at")
    # Repeated rows in several tasks give equal places, which have the same rank.
    ranked = hashed_spans(own, how).withColumn("_n", F.dense_rank().over(order))
    hits = ranked.where("again OR _n > 1").select(*KEYS, "at")
    lists = hits.groupBy(*KEYS).agg(F.collect_list("at").alias("_at"))
    joined = own.join(lists, list(KEYS), "left").select("doc_id", "text", "_at")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 8 << 20):
            rows = []
            texts = batch.column("text").to_pylist()
            for text, found in zip(texts, batch.column("_at").to_pylist(), strict=True):
                text, found = text or "", found or []
                n = -1 - min(found, default=-1)
                drop = {k for at in found if at >= 0 for k in range(at, min(n, at + how.run))}
                rows.append((without(text, drop) if drop else text, n, len(drop)))
            arrays = [
                pa.array(c, t)
                for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], names=["doc_id", "text", "n_sentences", "n_removed"]
            )

    return joined.mapInArrow(lean(apply), "doc_id bigint, text string, n_sentences bigint, n_removed bigint")
