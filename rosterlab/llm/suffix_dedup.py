"""Exact removal of repeated byte strings, by sorting suffixes in ranges.

Every byte that lies in a ``length``-byte string which also starts earlier (in a smaller
``doc_id``, or earlier in the same document) is removed. Matches never cross documents and are
judged on the input, not on what is left of it.

1. Of the ``gram``-byte tokens in a window of ``length`` bytes, one is the window's leading token:
   the one with the smallest hash. It depends on the window's bytes alone, so equal windows have
   the same one, and neighbouring windows mostly share it. Windows with the same leading token that
   follow each other are kept as one stretch of text, so a byte is written some three times
   instead of ``length`` times.
2. Sampled splitters cut the order of leading tokens into ranges, at most ``most_splitters`` of them in the
   driver; what they would leave too large is dealt on by a hash of the token. Stretches go to the
   range of their token, packed and compressed. Of a stretch that occurs often in a task's texts only the
   earliest place goes there; the others are later than it and are settled by the sender. Splitters
   are whole tokens: equal windows cannot end up on two sides of a boundary, so neighbours need
   only be compared within a range.
3. In a range, equal stretches are found first: all but the earliest are repeats as a whole. Different
   stretches under one token are compared by the suffixes that start at their windows, sorted by
   multikey quicksort over 8-byte characters: each step splits every group of still equal suffixes
   by the next character and drops those that stand alone; what is left agrees in ``length`` bytes.
4. A token that the sample finds in more text than ``hot`` ranges should hold is not kept
   together: its windows are dealt one by one, by a hash of the whole window, and only equal
   windows meet. Of a window that very many documents share, one place and one copy for each
   ``flush_bytes`` of text meet there.
5. The removed pieces meet the texts by a join. A filter of fixed size, one bit for a hash of each
   document with pieces, tells most of the other documents beforehand: these are not shuffled. With so many
   documents that the filter is full, more are shuffled and nothing else changes.

Null is the empty text; nothing is removed from texts shorter than ``length``. Rows that share
``doc_id`` are ordered by a hash of their text; rows that share both are one document, and each
gets its result. Null ids come first. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import (
    KEY,
    KEYS,
    TIE,
    document_runs,
    encoded,
    extended,
    give_back,
    in_slices,
    keyed,
    lean,
    stored,
)

_CHUNK = 1 << 17
_PIECES, _OUT = "_removed_pieces", "_out_"
_PLACE = 24  # low bits that hold a place in a chunk
_OCCURRENCE = np.dtype([("stretch", "<i4"), ("doc", "<i8"), ("tie", "<i8"), ("at", "<i8")])
_COLUMNS = ("<i4", "<i4", "<i1", "<i8", "<i8", "<i8")  # size, lead, inner, doc, tie and at of a stretch

@dataclass(frozen=True)
class Dedup:
    length: int = 100
    gram: int = 16
    range_bytes: int = 2 << 20  # text whose windows a range holds on average
    sampled_per_range: int = 64
    most_splitters: int = 1 << 15
    filter_bits: int = 1 << 26
    hot: float = 2.0
    flush_bytes: int = 4 << 20  # text of a task that is looked at together
    level: int = 3


def token_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram``-byte token; ``gram`` is a power of two."""
    table = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * 2 + 1
    h, size, factor = table[text], 1, 0x9E3779B97F4A7C15
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64) | 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, how: Dedup):
    """(start, windows, place of the leading token, whether it recurs) of all stretches.

    ``text`` holds documents side by side at ``begins`` … ``ends``.
    """
    length, gram = how.length, how.gram
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    hashes = token_hashes(text, gram)
    low = np.uint64((1 << _PLACE) - 1)
    placed = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
    lead = (smallest(placed, length - gram + 1) & low).astype(np.int64)
    full = hashes[lead]
    edge = np.zeros(len(text) + 1, np.int64)
    long = ends - begins >= length
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge)[: len(lead)])
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(window) != 1) | (full[window[1:]] != full[window[:-1]])
    # A window at a document's first byte starts anew even if the one before it is in use.
    new |= np.isin(window, begins)
    first = np.flatnonzero(new)
    start = window[first]
    count = np.diff(np.append(first, len(window)))
    recurs = lead[start + count - 1] != lead[start]
    return start, count, lead[start], recurs.astype(np.int64)


def chunks(texts: list[tuple[int, int, bytes]], how: Dedup):
    """Documents side by side in chunks; a long one in parts that share ``length - 1`` bytes."""
    part: list[tuple[int, int, int, bytes]] = []
    held = 0
    for doc, tie, text in texts:
        for at in range(0, max(0, len(text) - how.length) + 1, _CHUNK):
            piece = text[at : at + _CHUNK + how.length - 1]
            if held and held + len(piece) > 2 * _CHUNK:
                yield part
                part, held = [], 0
            part.append((doc, tie, at, piece))
            held += len(piece)
    if part:
        yield part


def token_parts(tokens: np.ndarray, parts: int) -> np.ndarray:
    """A part for each token (a row of bytes), by a hash."""
    h = np.full(len(tokens), 0x9E3779B97F4A7C15, np.uint64)
    for word in np.ascontiguousarray(tokens).view("<u8").T:
        h = (h ^ word) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(parts)).astype(np.int64)


class Sender:
    """Collects the stretches of some documents, by range, and packs them."""

    def __init__(self, how: Dedup, splitters: np.ndarray, parts: int, hot: set[bytes], spread: int) -> None:
        self.how, self.splitters, self.parts, self.hot, self.spread = how, splitters, parts, hot, spread
        self.ordered = (len(splitters) + 1) * parts

    def pack(self, texts: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, bytes]]:
        """(range, packed stretches); a negative range has settled pieces instead."""
        how, length = self.how, self.how.length
        known: dict[bytes, int] = {}
        facts: list[tuple[int, int, int]] = []
        goes: list[int] = []
        places: list[np.ndarray] = []
        for part in chunks(sorted(texts), how):
            joined = b"".join(p[3] for p in part)
            sizes = np.array([len(p[3]) for p in part], np.int64)
            ends = np.cumsum(sizes)
            start, count, lead, inner = stretches(np.frombuffer(joined, np.uint8), ends - sizes, ends, how)
            if not len(start):
                continue
            buffer = np.frombuffer(joined, np.uint8)
            tokens = np.ascontiguousarray(buffer[lead[:, None] + np.arange(how.gram)])
            range_of = np.searchsorted(self.splitters, tokens.view(f"S{how.gram}").ravel(), "right")
            range_of = range_of * self.parts + token_parts(tokens, self.parts)
            owner = np.searchsorted(ends, start, "right")
            number = np.empty(len(start), np.int32)
            extra: list[tuple[int, int, int]] = []  # (stretch, place in the chunk, document)
            rows = zip(
                start.tolist(), count.tolist(), lead.tolist(), inner.tolist(), range_of.tolist(),
                owner.tolist(), strict=True,
            )
            for i, (s, n, at, again, to, own) in enumerate(rows):
                if self.hot and joined[at : at + how.gram] in self.hot:
                    number[i] = -1
                    for w in range(s, s + n):
                        window = joined[w : w + length]
                        found = known.setdefault(window, len(facts))
                        if found == len(facts):
                            facts.append((length, 0, 0))
                            goes.append(self.ordered + xxhash.xxh64_intdigest(window) % self.spread)
                        extra.append((found, w, own))
                    continue
                stretch = joined[s : s + n + length - 1]
                found = known.setdefault(stretch, len(facts))
                if found == len(facts):
                    facts.append((n + length - 1, at - s, again))
                    goes.append(to)
                number[i] = found
            kept = number >= 0
            number, start, owner = number[kept], start[kept], owner[kept]
            if extra:
                number = np.append(number, [e[0] for e in extra]).astype(np.int32)
                start = np.append(start, [e[1] for e in extra])
                owner = np.append(owner, [e[2] for e in extra])
            place = np.empty(len(start), _OCCURRENCE)
            place["stretch"] = number
            place["doc"] = np.array([p[0] for p in part], np.int64)[owner]
            place["tie"] = np.array([p[1] for p in part], np.int64)[owner]
            begin = (ends - sizes)[owner]
            place["at"] = np.array([p[2] for p in part], np.int64)[owner] + start - begin
            places.append(place)
        if not facts:
            return
        compress = zstandard.ZstdCompressor(level=how.level).compress
        fact = np.array(facts, np.int64)
        place, later = earliest(np.concatenate(places))
        if len(later):
            pieces = np.stack(whole_pieces(later, fact[:, 0]))
            yield -1 - int(later["tie"][0] % self.spread), compress(pieces.astype("<i8").tobytes())
        to = np.array(goes, np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1)).tolist() + [len(order)]
        texts_of = list(known)
        columns = [*fact.T, place["doc"], place["tie"], place["at"]]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b]
            own = [c[rows].astype(t).tobytes() for c, t in zip(columns, _COLUMNS, strict=True)]
            body = b"".join([texts_of[r] for r in rows.tolist()])
            yield int(to[rows[0]]), compress(np.int64(b - a).tobytes() + b"".join(own) + body)


def earliest(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest place of each stretch, by stretch, and all later ones.

    Rows that share id and text are one document: their equal places are one.
    """
    place = place[np.lexsort((place["at"], place["tie"], place["doc"], place["stretch"]))]
    other = np.ones(len(place), bool)
    other[1:] = place[1:] != place[:-1]
    place = place[other]
    first = np.ones(len(place), bool)
    first[1:] = place["stretch"][1:] != place["stretch"][:-1]
    return place[first], place[~first]


def whole_pieces(place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, tie, begin and end of stretches that are repeats as a whole."""
    return place["doc"], place["tie"], place["at"], place["at"] + size[place["stretch"]]


def unpacked(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    """The columns of packed stretches, and their texts."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    columns, at = [], 8
    for kind in _COLUMNS:
        columns.append(np.frombuffer(raw, kind, n, at))
        at += n * columns[-1].itemsize
    return columns, raw[at:]


def equal_suffixes(buffer: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that agree in their first ``length`` bytes with another one: (index, group).

    Multikey quicksort with 8-byte characters. Equal suffixes keep their order.
    """
    padded = np.frombuffer(buffer + bytes(8), np.uint8)
    character = np.ndarray((len(buffer) + 1,), ">u8", padded, strides=(1,))
    index = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for at in range(0, length, 8):
        if not len(index):
            break
        value = character[starts[index] + at].astype(np.uint64)
        if length - at < 8:
            value >>= np.uint64(8 * (8 - (length - at)))
        order = np.lexsort((value, group)) if at else np.argsort(value, kind="stable")
        index, group, value = index[order], group[order], value[order]
        new = np.ones(len(index) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        alone = new[:-1] & new[1:]
        group = np.cumsum(new[:-1])[~alone]
        index = index[~alone]
    return index, group


def repeats(blobs: list[bytes], how: Dedup, whole_only: bool) -> np.ndarray:
    """Removed pieces (doc, tie, begin, end) that a range's stretches show."""
    length = how.length
    known: dict[bytes, int] = {}
    facts: list[tuple[int, int, int]] = []
    places = []
    for blob in blobs:
        (size, lead, inner, doc, tie, begin), body = unpacked(blob)
        place = np.empty(len(size), _OCCURRENCE)
        place["doc"], place["tie"], place["at"] = doc, tie, begin
        number = np.empty(len(size), np.int32)
        at = 0
        for i, fact in enumerate(zip(size.tolist(), lead.tolist(), inner.tolist(), strict=True)):
            stretch = body[at : at + fact[0]]
            at += fact[0]
            found = known.setdefault(stretch, len(facts))
            if found == len(facts):
                facts.append(fact)
            number[i] = found
        place["stretch"] = number
        places.append(place)
    own, later = earliest(np.concatenate(places))
    fact = np.array(facts, np.int64)
    out = [whole_pieces(later, fact[:, 0])]
    if not whole_only:
        # Different stretches, in the order of their earliest places.
        own = own[np.lexsort((own["at"], own["tie"], own["doc"]))]
        texts = list(known)
        size, lead, inner = fact[own["stretch"]].T
        buffer = b"".join([texts[s] for s in own["stretch"].tolist()])
        begin = np.cumsum(size) - size
        same, _ = equal_suffixes(buffer, begin + lead, how.gram)
        asked = inner > 0
        asked[same] = True
        rows = np.flatnonzero(asked)
        windows = size[rows] - length + 1
        row = np.repeat(rows, windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        index, group = equal_suffixes(buffer, begin[row] + offset, length)
        if len(index):
            again = np.zeros(len(row), bool)
            again[index[1:][group[1:] == group[:-1]]] = True
            hit = np.flatnonzero(again)
            cut = np.ones(len(hit), bool)
            cut[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
            a = hit[cut]
            z = hit[np.append(np.flatnonzero(cut)[1:] - 1, len(hit) - 1)]
            o = own[row[a]]
            out.append((o["doc"], o["tie"], o["at"] + offset[a], o["at"] + offset[z] + length))
    return np.stack([np.concatenate(c) for c in zip(*out, strict=True)], axis=1)


def splitters(docs: DataFrame, ranges: int, total: int, how: Dedup) -> tuple[np.ndarray, set[bytes]]:
    """Tokens between ranges, and tokens too frequent for one, from a sample of documents.

    The sample has some ``sampled_per_range`` tokens for each of at most ``most_splitters`` ranges.
    """
    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in document_runs(batches, how.flush_bytes):
            for part in chunks(texts, how):
                joined = b"".join(p[3] for p in part)
                sizes = np.array([len(p[3]) for p in part], np.int64)
                ends = np.cumsum(sizes)
                buffer = np.frombuffer(joined, np.uint8)
                start, _, lead, _ = stretches(buffer, ends - sizes, ends, how)
                found = [joined[a : a + how.gram] for a in lead.tolist()]
                # A share of each document's tokens, so that a long one does not weigh too much.
                picked = [f for f, s in zip(found, start.tolist(), strict=True) if s % 8 == 0]
                yield pa.RecordBatch.from_arrays([pa.array(picked, pa.binary())], names=["token"])

    cut = min(ranges, how.most_splitters)
    wanted = cut * how.sampled_per_range
    share = min(1.0, 8 * wanted * (how.length - how.gram) / 2 / max(1, total))
    chosen = docs.where(F.pmod(F.xxhash64(KEY, TIE, F.lit(7)), F.lit(1 << 20)) <= int(share * (1 << 20)))
    found = chosen.mapInArrow(lean(leads), "token binary").toArrow()["token"].combine_chunks()
    joined = b"".join(t.as_buffer() for t in found)
    tokens = np.sort(np.frombuffer(joined, f"S{how.gram}"))
    if not len(tokens):
        return tokens, set()
    cuts = tokens[np.linspace(0, len(tokens), cut + 1)[1:-1].astype(int)]
    values, counts = np.unique(tokens, return_counts=True)
    many = counts > max(8, how.hot * len(tokens) / ranges)
    return np.unique(cuts), {bytes(v).ljust(how.gram, b"\0") for v in values[many]}


def repeated_pieces(docs: DataFrame, how: Dedup) -> DataFrame:
    """Removed pieces of the keyed ``docs``: key, begin, end (they may overlap)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(1, -(-total // how.range_bytes))
    cuts, hot = splitters(docs, ranges, total, how)
    sender = Sender(how, cuts, -(-ranges // min(ranges, how.most_splitters)), hot, ranges)
    shared = docs.sparkSession.sparkContext.broadcast(sender)  # some bytes a splitter

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in document_runs(batches, how.flush_bytes):
            packed = list(shared.value.pack(texts))
            for i in range(0, len(packed), 64):
                to, blobs = zip(*packed[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "blob"]
                )

    ordered = sender.ordered

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        blobs = group["blob"].tolist()
        if int(key[0]) < 0:
            settled = (zstandard.ZstdDecompressor().decompress(b) for b in blobs)
            found = np.concatenate([np.frombuffer(b, "<i8").reshape(4, -1).T for b in settled])
        else:
            found = repeats(blobs, how, int(key[0]) >= ordered)
        give_back()
        return pd.DataFrame(found, columns=[*KEYS, "begin", "end"])

    sent = docs.mapInArrow(lean(send), "range bigint, blob binary")
    return sent.groupBy("range").applyInPandas(
        compare, f"{KEY} bigint, {TIE} bigint, begin bigint, end bigint"
    )


_FILTER_ROW = 1 << 15  # bits of one bitmap


def touched(docs: DataFrame, pieces: DataFrame, how: Dedup) -> tuple[DataFrame, DataFrame]:
    """``docs`` that may have pieces, and those that have none, by a filter of ``filter_bits`` bits."""
    rows = max(1, how.filter_bits // _FILTER_ROW)
    place = F.pmod(F.xxhash64(F.lit(3), *KEYS), F.lit(rows * _FILTER_ROW)).alias("_place")
    row, bit = F.floor(F.col("_place") / _FILTER_ROW).alias("_row"), F.col("_place") % _FILTER_ROW
    maps = pieces.select(place).groupBy(row).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    maps = F.broadcast(stored(maps, "filter"))  # at most filter_bits / 8 bytes
    marked = docs.select("*", place).select("*", row).join(maps, "_row", "left")
    byte = F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))
    marked = marked.withColumn("_byte", F.conv(F.hex(byte), 16, 10).cast("int"))
    hit = F.coalesce(F.expr("shiftright(_byte, cast(_place % 8 AS int)) & 1 = 1"), F.lit(False))
    return marked.where(hit).select(docs.columns), marked.where(~hit).select(docs.columns)


def without(text: bytes, pieces: list | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    if not pieces:
        return text, 0
    kept, runs, at, until = [], 0, 0, -1
    for piece in sorted((p["begin"], p["end"]) for p in pieces):
        if piece[0] > until:
            if until >= 0:
                at = until
            kept.append(text[at : piece[0]])
            runs += 1
        until = max(until, piece[1])
    kept.append(text[until:])
    return b"".join(kept), runs


def remove_repeats(docs: DataFrame, how: Dedup | None = None, keep_columns: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    ``kept_text`` drops bytes of characters that were cut in the middle; the digest is of all
    remaining bytes. With ``keep_columns`` the result has the columns of ``docs`` instead, with
    the kept text as text and its number of characters as n_chars, if there is one.
    """
    how = how or Dedup()
    passed = [c for c in docs.columns if c not in ("text", "n_chars")] if keep_columns else ["doc_id"]
    own = keyed(docs, *passed)
    pieces = stored(repeated_pieces(own.select(*KEYS, "text"), how), "pieces")
    lists = pieces.groupBy(*KEYS).agg(F.collect_list(F.struct("begin", "end")).alias(_PIECES))
    some, others = touched(own, pieces, how)
    joined = some.join(lists, list(KEYS), "left").select(*passed, "text", _PIECES)
    untouched = others.select(*passed, "text", F.lit(None).cast(lists.schema[_PIECES].dataType).alias(_PIECES))
    joined = joined.unionByName(untouched)
    new = {"kept_text": "string"}
    if not keep_columns:
        new = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"} | new

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 8 << 20):
            rows = []
            texts = encoded(batch.column("text"))
            for text, found in zip(texts, batch.column(_PIECES).to_pylist(), strict=True):
                left, runs = without(text, found)
                whole = left.decode("utf-8", "ignore")
                digest = hashlib.sha256(left).hexdigest()
                rows.append((len(text), len(text) - len(left), runs, digest, whole))
            columns = list(zip(*rows, strict=True))[-len(new) :]
            types = [pa.int64() if t == "bigint" else pa.string() for t in new.values()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in passed), *arrays], names=[*passed, *(_OUT + n for n in new)]
            )

    out = joined.mapInArrow(
        lean(apply), extended(joined.select(*passed).schema, **{_OUT + n: t for n, t in new.items()})
    )
    if not keep_columns:
        return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(_OUT + n).alias(n) for n in new))
    text = F.col(_OUT + "kept_text")
    made = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return out.select(*(made[c].alias(c) if c in made else c for c in docs.columns))
