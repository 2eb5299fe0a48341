"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become token ids (plus an end id); one longer than a sequence is cut into pieces of
exactly a sequence's length, its first piece taking the rest. Full pieces are sequences of their
own. The others are dealt by a hash into groups of some ``group_pieces`` and each group is packed
online: a piece goes into the fullest open sequence that still takes it, found in a bitset keyed
by free space. At most ``open_bins`` sequences are open; the fullest closes first. Ids of
sequences are group and number, so nothing is agreed on between tasks, and what a task holds is
bounded by ``group_pieces`` whatever the input.

Texts: null is empty, and an empty document is its end id alone. Repeated rows are packed each, and
dealt apart by their place in the stored pieces, so that copies of one row do not fill a group.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import KEY, KEYS, TIE, in_slices, keyed, lean, stored

# Fixed value: how a byte-level vocabulary of this family splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP_BITS = 31
LONG_WORD = 2000
_PROBES = ("", "a", "the  thing\n\n  it's 12.5%", "é　\U0001f600\x00 ▁q", "<|endoftext|> x", "a" * 50)


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    end_id: int = 2
    length: int = 1024
    open_bins: int = 512
    group_pieces: int = 100_000


def byte_names() -> dict[str, int]:
    """The characters by which a byte-level vocabulary file writes the 256 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TextIds:
    """Ids of texts with a byte-level vocabulary file.

    The file's words and their order go to tiktoken, which merges several times faster than the
    library the file is written for. That library (``slow``) encodes texts with words too long for
    it, word by word, and both must agree on some probes.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        self.split = regex.compile(SPLIT).findall
        names = byte_names()
        ranks = {
            bytes(names[c] for c in word): i
            for word, i in self.slow.get_vocab(with_added_tokens=False).items()
            if all(c in names for c in word) and word not in self.slow.get_added_tokens_decoder()
        }
        for special in self.slow.get_added_tokens_decoder().values():
            ranks.pop(special.content.encode(), None)
        self.fast = tiktoken.Encoding(
            "byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        )
        for probe in _PROBES:
            if self(probe) != self.by_words(probe):
                raise ValueError(f"{path} is not a byte-level vocabulary in order of its merges")

    def by_words(self, text: str) -> bytes:
        words = self.split(text)
        found = self.slow.encode_batch(words, add_special_tokens=False)
        return b"".join(np.asarray(e.ids, "<u4").tobytes() for e in found)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        words = text.split()
        blanks = len(text) - sum(map(len, words))
        if blanks - len(words) > LONG_WORD or max(map(len, words), default=0) > LONG_WORD:
            return self.by_words(text)
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    """One per Python worker."""
    return TextIds(path)


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``total`` tokens."""
    first = total % length or length
    return [(0, first)] + [(s, length) for s in range(first, total, length)]


PIECES = (
    f"doc_id bigint, {KEY} bigint, {TIE} bigint, piece int, start bigint, length bigint,"
    " ids_crc32 bigint, ids binary"
)


def tokenised(docs: DataFrame, how: Packing, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``ids`` (little-endian unsigned 32-bit) only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(how.tokenizer)
        end = np.asarray([how.end_id], "<u4").tobytes()
        for batch in in_slices(batches, "text", 4 << 20):
            columns = [batch.column(n).to_pylist() for n in ("doc_id", KEY, TIE, "text")]
            out: list[tuple] = []
            for doc_id, doc, tie, text in zip(*columns, strict=True):
                ids = ids_of(text or "") + end
                for n, (start, size) in enumerate(cut(len(ids) // 4, how.length)):
                    part = ids[4 * start : 4 * (start + size)]
                    out.append(
                        (doc_id, doc, tie, n, start, size, zlib.crc32(part), part if with_ids else None)
                    )
            names = [x.split()[0] for x in PIECES.split(",")]
            types = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return keyed(docs, F.col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(lean(run), PIECES)


class OpenBins:
    """Sequences that still take pieces, in a bitset keyed by their free space."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.bits = self.count = self.made = 0
        self.by_free: dict[int, list[int]] = {}

    def _open(self, free: int, number: int) -> None:
        self.by_free.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        numbers = self.by_free[free]
        number = numbers.pop()
        if not numbers:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number, offset = self._take(free), self.length - free
        else:
            free, number, offset = self.length, self.made, 0
            self.made += 1
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        if free > size:
            self._open(free - size, number)
        return number, offset


def packed(pieces: DataFrame, how: Packing) -> DataFrame:
    """``pieces`` (stored rows) with ``sequence_id`` and ``offset``."""
    whole = F.col("length") == how.length
    n = pieces.where(~whole).count()
    groups = max(1, -(-n // how.group_pieces))
    # With a row's place in the stored table, which a repeated task finds again.
    spread = F.xxhash64(KEY, TIE, "piece", F.monotonically_increasing_id())
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    out += ", sequence_id bigint, offset bigint" + (", ids binary" if "ids" in pieces.columns else "")
    names = [x.split()[0] for x in out.split(", ")]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*KEYS, "piece", "start"], kind="stable")
        bins = OpenBins(how.length, how.open_bins)
        placed = [bins.place(size) for size in group["length"].tolist()]
        number = np.array([p[0] for p in placed], "int64")
        group["sequence_id"] = group["_group"] * (1 << GROUP_BITS) + number
        group["offset"] = np.array([p[1] for p in placed], "int64")
        return group[names]

    rest = (
        pieces.where(~whole)
        .withColumn("_group", F.pmod(spread, F.lit(groups)).cast("bigint"))
        .groupBy("_group")
        .applyInPandas(pack, out)
    )
    # Negative numbers: never those of a group. The number is the row's place in its task.
    alone = pieces.where(whole).select(
        *[c for c in names if c not in ("sequence_id", "offset", "ids")],
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
        *(["ids"] if "ids" in names else []),
    )
    return rest.unionByName(alone)


def pack_documents(docs: DataFrame, how: Packing, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = tokenised(docs, how, with_ids)
    return packed(stored(pieces if with_ids else pieces.drop("ids"), "pieces"), how)
