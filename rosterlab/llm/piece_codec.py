"""Exact encoding and decoding with a merge-type sentencepiece model, without running its merges.

A text is cut where no piece can reach across (before a space that follows something else, and
around line ends); each unit is encoded by backtracking: an Aho-Corasick pass finds the longest
piece at every position, the walk takes the longest one that is compatible with the piece
before, falls back to shorter ones, and marks positions from which no way leads on in a bitfield.
Two neighbours are compatible if merging their joined text again gives just these two; a piece
that its own text does not merge to is never used. Units of up to ``long_unit`` characters are
remembered, in two generations of some ``known_bytes`` together; longer ones are encoded each time.

Pieces for runs of spaces share one score, so for units with such runs the order of merges
depends on positions and neighbours do not decide it; those units are merged directly.

Null is the empty text: its only id is the end id, and it decodes to nothing. Rows are encoded
one by one, so repeated rows get equal results and an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import in_slices

SPACE = "▁"
_SHORT = 24
_FEW = 48  # units left to walk, from which one at a time is quicker
_SLOTS = 1 << 20
_UNITS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
_PROBES = ("", " ", "a", "  a  b ", "x\n\ny\tz", "é　\U0001f600 ▁q", "the thing, (is) 12.5%")


def units_of(text: str) -> list[str]:
    return _UNITS(SPACE + text.replace(" ", SPACE)) if text else []


class PieceCodec:
    """``encode`` and ``decode`` for one model file."""

    def __init__(
        self, path: str, known_bytes: int = 240 << 20, known_pairs: int = 500_000, long_unit: int = 200
    ) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(count)]
        self.end = model.eos_id()
        special = {i for i in range(count) if model.is_control(i) or model.is_unknown(i)}
        byte_of = {i: int(pieces[i][3:5], 16) for i in range(count) if model.is_byte(i)}
        normal = [i for i in range(count) if i not in special and i not in byte_of]
        self.ids = {pieces[i]: i for i in normal}
        self.score = {pieces[i]: model.get_score(i) for i in normal}
        self.normal = set(normal)
        self.id_of_byte = {b: i for i, b in byte_of.items()}
        # What each id stands for in decoded text; nothing for special ids.
        self.spelling = [b""] * count
        for i in normal:
            self.spelling[i] = pieces[i].replace(SPACE, " ").encode()
        for i, b in byte_of.items():
            self.spelling[i] = bytes([b])
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError(f"{path} has pieces that reach across words or lines")
        usable = [p for p in self.ids if self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        # Pieces of one character are looked up by it; the rest are found by the automaton.
        self.single = np.full(0x110000, count, np.int64)
        for p in usable:
            if len(p) == 1:
                self.single[ord(p)] = self.ids[p]
            else:
                self.automaton.add_word(p, self.ids[p])
        self.automaton.make_automaton()
        self.pieces = pieces
        # The longest shorter piece that a piece begins with.
        whole = set(usable)
        self.shorter = {
            p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), None) for p in usable
        }
        # The same by id, for walking many units at once; the last entry is a character that has
        # no piece. Then a memory of pairs, by a hash of the pair.
        self.length = np.array([*map(len, pieces), 1], np.int64)
        self.shorter_id = np.full(count + 1, -1, np.int64)
        for p, q in self.shorter.items():
            self.shorter_id[self.ids[p]] = -1 if q is None else self.ids[q]
        self.slot_pair = np.full(_SLOTS, -1, np.int64)
        self.slot_fits = np.zeros(_SLOTS, bool)
        self.decimal = [str(i) for i in range(count)]
        self.pairs: dict[tuple[str, str], bool] = {}
        # Two generations: when the younger is full it becomes the older, so that what is used
        # all the time stays known.
        self.units: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0
        self.known_bytes, self.known_pairs, self.long_unit = known_bytes // 2, known_pairs, long_unit
        for probe in _PROBES:
            if self.encode(probe) != model.encode(probe):
                raise ValueError(f"{path} is not a merge-type model without normalisation")

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals, until none is a piece."""
        if len(text) <= _SHORT:
            return self.merged_short(list(text))
        parts: list[str | None] = list(text)
        right = list(range(1, len(parts))) + [-1]
        left = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            joined = parts[a] + parts[b]
            score = self.score.get(joined)
            if score is not None:
                heapq.heappush(queue, (-score, a, b, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        return [p for p in parts if p is not None]

    def merged_short(self, parts: list[str]) -> list[str]:
        """The same by looking at all neighbours each time, which is quicker for a few."""
        score = self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.known_pairs:
                self.pairs.clear()
            known = a + b not in self.ids and self.merged(a + b) == [a, b]
            self.pairs[a, b] = known
        return known

    def walked(self, unit: str) -> list[str]:
        """Pieces of a unit by backtracking; a character without a piece stands for itself."""
        # Matches come by their ends, so of those with one start the longest comes last.
        pieces = self.pieces
        matches = ((end, pieces[i]) for end, i in self.automaton.iter(unit))
        longest = {end + 1 - len(piece): piece for end, piece in matches}
        pairs, shorter = self.pairs.get, self.shorter.get
        taken: list[str] = []
        failed, at, size = 0, 0, len(unit)  # failed: a bit for each position
        last = None
        piece: str | None = longest.get(0) or unit[:1]
        while at < size:
            while piece is not None:
                to = at + len(piece)
                if not failed >> to & 1:
                    fits = last is None or pairs((last, piece))
                    if fits or fits is None and self.compatible(last, piece):
                        break
                piece = shorter(piece)
            if piece is not None:
                taken.append(piece)
                at = to
                last = piece
                piece = longest.get(at) or unit[at : at + 1]
            elif taken:
                failed |= 1 << at
                dropped = taken.pop()
                at -= len(dropped)
                last = taken[-1] if taken else None
                piece = shorter(dropped)
            else:
                raise AssertionError(f"no way through {unit!r}")
        return taken

    def ids_of_unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for part in self.merged(unit) if unit.startswith(SPACE * 2) else self.walked(unit):
            found = self.ids.get(part)
            out += [found] if found is not None else [self.id_of_byte[b] for b in part.encode()]
        return out

    def fits(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs of ids."""
        raw = len(self.pieces)
        pair = last * (raw + 1) + piece
        slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)
        out = self.slot_fits[slot]
        unknown = np.flatnonzero(self.slot_pair[slot] != pair)
        if len(unknown):
            pairs, back = np.unique(pair[unknown], return_inverse=True)
            found = np.array(
                [
                    raw in (a, b) or self.compatible(self.pieces[a], self.pieces[b])
                    for a, b in zip((pairs // (raw + 1)).tolist(), (pairs % (raw + 1)).tolist(), strict=True)
                ],
                bool,
            )
            out[unknown] = found[back]
            self.slot_pair[slot[unknown]] = pair[unknown]
            self.slot_fits[slot[unknown]] = out[unknown]
        return out

    def walked_together(self, units: list[str]) -> list[list[int]]:
        """``walked`` for many units side by side, as ids; -1 stands for a character without one."""
        raw = len(self.pieces)
        text = "\n".join(units) + "\n"
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.cumsum(sizes + 1) - 1
        start = stop - sizes
        matches = [end << 16 | i for end, i in self.automaton.iter(text)]
        packed = np.array(matches, np.int64)
        ids, ends = packed & 0xFFFF, packed >> 16
        longest = self.single[np.frombuffer((text + "\n").encode("utf-32-le"), "<u4")]
        longest[ends + 1 - self.length[ids]] = ids  # by their ends, so the longest comes last
        failed = np.zeros(len(text) + 1, bool)
        piece_at = np.zeros(len(text) + 1, np.int64)
        came_from = np.zeros(len(text) + 1, np.int64)
        at, last, piece = start.copy(), np.full(len(units), -1), longest[start]
        live = np.flatnonzero(sizes)
        while len(live) > _FEW:
            here, try_, before = at[live], piece[live], last[live]
            some = try_ >= 0
            to = np.where(some, here + self.length[try_], here)
            good = some & ~failed[to]
            ask = np.flatnonzero(good & (before >= 0))
            good[ask] = self.fits(before[ask], try_[ask])
            go, end = live[good], to[good]
            piece_at[here[good]] = try_[good]
            came_from[end] = here[good]
            at[go], last[go], piece[go] = end, try_[good], longest[end]
            less = some & ~good
            piece[live[less]] = self.shorter_id[try_[less]]
            back = live[~some]
            if len(back):
                dead = here[~some]
                if (dead == start[back]).any():
                    raise AssertionError("no way through a unit")
                failed[dead] = True
                previous = came_from[dead]
                dropped = piece_at[previous]
                first = previous == start[back]
                last[back] = np.where(first, -1, piece_at[came_from[previous]])
                at[back], piece[back] = previous, self.shorter_id[dropped]
            live = live[at[live] < stop[live]]
        late = set(live.tolist())
        taken, length = piece_at.tolist(), self.length.tolist()
        out = []
        for n, (pos, end) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
            if n in late:
                out.append([self.ids.get(p, -1) for p in self.walked(units[n])])
                continue
            path = []
            while pos < end:
                i = taken[pos]
                path.append(i if i < raw else -1)
                pos += length[i]
            out.append(path)
        return out

    def keep(self, unit: str, ids: list[int]) -> tuple[bytes, bytes]:
        """Remember a unit: its ids as text, and what they decode to."""
        return self.keep_as(
            unit, (" ".join(map(self.decimal.__getitem__, ids)).encode(), self.spelled(ids))
        )

    def keep_as(self, unit: str, got: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        if len(unit) > self.long_unit:
            return got
        # What an entry takes in Python, some 300 bytes besides its texts.
        size = 300 + 2 * len(unit) + len(got[0]) + len(got[1])
        if self.held + size > self.known_bytes:
            self.older, self.units, self.held = self.units, {}, 0
        self.held += size
        self.units[unit] = got
        return got

    def looked_up(self, unit: str) -> tuple[bytes, bytes]:
        got = self.older.get(unit)
        if got is None:
            return self.keep(unit, self.ids_of_unit(unit))
        return self.keep_as(unit, got)

    def learn(self, units: Iterable[str]) -> None:
        """Encode units that are not known yet, together."""
        new = [u for u in dict.fromkeys(units) if u not in self.units and u not in self.older]
        new = [u for u in new if len(u) <= self.long_unit and not u.startswith(SPACE * 2)]
        marked = [u for u in new if u[-1] in ",." and len(u) > 1]
        plain = [u for u in new if u[-1] not in ",." or len(u) == 1]
        plain = [*dict.fromkeys([*plain, *(u[:-1] for u in marked if u[:-1] not in self.units)])]
        for unit, path in zip(plain, self.walked_together(plain) if plain else [], strict=True):
            if -1 in path:
                self.keep(unit, self.ids_of_unit(unit))
            else:
                self.keep(unit, path)
        for unit in marked:
            # The ids of the rest and of the mark, if the neighbours are compatible.
            rest = self.units.get(unit[:-1])
            last = int(rest[0][rest[0].rfind(b" ") + 1 :]) if rest else -1
            if last in self.normal and self.compatible(self.pieces[last], unit[-1]):
                self.keep_as(unit, (b"%b %d" % (rest[0], self.ids[unit[-1]]), rest[1] + unit[-1].encode()))
            else:
                self.keep(unit, self.ids_of_unit(unit))

    def spelled(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))

    def parts(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        known, look = self.units.get, self.looked_up
        return [known(u) or look(u) for u in units]

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.parts(units_of(text)) for i in part[0].split()]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids; the space that encoding puts in front is taken away again."""
        return self.spelled(ids).removeprefix(b" ").decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec per Python worker, so that what it knows outlives a task."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and the decoded text.

    The ids end with the end id. The digests are of the decimal ids joined by one space and of
    the decoded text in UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        end = str(known.end).encode()
        for batch in in_slices(batches, "text", 4 << 20):
            counts, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            cut = [units_of(t or "") for t in batch.column("text").to_pylist()]
            known.learn(itertools.chain.from_iterable(cut))
            for units in cut:
                parts = known.parts(units)
                ids = b" ".join([p[0] for p in parts] + [end])
                decoded = b"".join([p[1] for p in parts]).removeprefix(b" ")
                counts.append(ids.count(b" ") + 1)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(list(map(int, ids.split())))
                    texts.append(decoded.decode("utf-8", "replace"))
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(ids_sha, pa.string()),
                "decoded_sha256": pa.array(text_sha, pa.string()),
            }
            if with_ids:
                out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(texts)}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
