"""Compression bands: reject text that compresses too well or too badly for its length.

Each document is compressed whole and in fixed chunks with zstandard. The ratio (bytes before by
bytes after) must lie in the band of the document's length class; the share of chunks outside
the chunk band must stay small. The last chunk is the text's final ``chunk_bytes``, so every byte is
in a chunk of full size; a shorter text is one chunk, with the band of its length class. Repetitive text has high ratios, random strings low ones. The
bands are fixed parameters: they depend on the length only, never on the table.

Plain counts (words, symbols, repeated lines and windows) are reported too, and a document that
fails the base rule is not kept. Null and empty texts have no words: they fail the base rule.
Words are runs of anything but the six ASCII blanks; lines end at ``\\n`` alone. Rows are judged
one by one, so repeated rows get equal results and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import encoded, in_slices

_SYMBOL = re.compile(rb"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """(bytes up to, lowest ratio, highest ratio) by length; the last class has no end."""

    whole: tuple[tuple[float, float, float], ...] = (
        (256, 0.80, 2.4),
        (1024, 1.10, 3.2),
        (4096, 1.30, 3.8),
        (16384, 1.45, 4.4),
        (float("inf"), 1.55, 5.0),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.20, 4.0)
    most_odd_chunks: float = 0.34
    level: int = 3
    least_words: int = 20
    window: int = 8
    most_repeated: float = 0.30


def repeated_words(words: list[bytes], window: int, factors: np.ndarray) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for j in range(window):
        keys += ids[j : j + n] * factors[j]
    keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.split():
            seen.add(line)
    return again


def ratio(text: bytes, compress) -> float:
    return len(text) / len(compress(text)) if text else 0.0


COLUMNS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "base_failed": "boolean",
    "kept": "boolean",
    "ratio": "double",
    "odd_chunks": "double",
    "reason": "string",
}


def judge(text: bytes, bands: Bands, compress, factors: np.ndarray) -> tuple:
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    again = repeated_words(words, bands.window, factors)
    base = len(words) < bands.least_words or 100 * again > round(100 * bands.most_repeated) * len(words)
    whole = ratio(text, compress)
    step = bands.chunk_bytes
    low, high = next((lo, hi) for upto, lo, hi in bands.whole if len(text) <= upto)
    if len(text) < step:
        odd = float(bool(text) and not low <= whole <= high)
    else:
        # The last chunk ends with the text and overlaps the one before, so it has full size too.
        starts = [*range(0, len(text) - step, step), len(text) - step]
        chunks = [ratio(text[i : i + step], compress) for i in starts]
        odd = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in chunks) / len(chunks)
    reason = (
        "base" if base
        else "incompressible" if whole < low
        else "repetitive" if whole > high
        else "chunks" if odd > bands.most_odd_chunks
        else None
    )
    counts = (len(words), chars, len(_SYMBOL.findall(text)), repeated_lines(text), again)
    return (*counts, base, reason is None, whole, odd, reason)


def compression_rules(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """doc_id with the counts, base_failed, kept, the ratios and the reason for a refusal."""
    bands = bands or Bands()
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=bands.level, write_checksum=False).compress
        factors = np.random.default_rng(8).integers(1, 1 << 63, bands.window, np.uint64) * 2 + 1
        for batch in in_slices(batches, "text", 8 << 20):
            got = [judge(t, bands, compress, factors) for t in encoded(batch.column("text"))]
            arrays = [
                pa.array(c, types[t]) for c, t in zip(zip(*got, strict=True), COLUMNS.values(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], names=["doc_id", *COLUMNS]
            )

    schema = "doc_id bigint, " + ", ".join(f"{n} {t}" for n, t in COLUMNS.items())
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
