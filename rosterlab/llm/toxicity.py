"""A small convolutional text classifier for toxicity.

A word's embedding is the sum of three hashed rows: of the word, of its first four and of its first
six bytes, so that endings never seen before still find their stem. Filters over one, two and
three neighbouring words are max-pooled over the whole text and feed a logistic output.

It is trained on every labelled document. These are dealt by a hash into parts of some ``part_bytes``; in
each of ``rounds`` rounds every part goes on from the common weights in its own task, and their changes are
averaged: a word's over the parts that changed it, all others by the parts' rows. Changes are
added as whole numbers, so the result does not depend on how parts meet in tasks. A third of each part
is kept back to choose a threshold for each of the ``languages`` most frequent languages that has
``least_of_a_language`` texts of both labels, and one for all others; the language is guessed from the
same word hashes, never read from the row. The score is the logistic of the distance to
the threshold of the guessed language, so 0.5 is always the line. What reaches the driver has the size of
the network: summed changes, word counts by language, and counts of outputs rounded to ``1 / _LINES``.

Null and empty texts are scored like a text of padding. Rows are
scored one by one, so repeated rows get equal results and an empty table gives no rows. Without
labels of both kinds every score is the share of label 1, or 0.
"""

from __future__ import annotations

import copy
import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import (
    KEY,
    KEYS,
    TIE,
    encoded,
    extended,
    give_back,
    in_slices,
    keyed,
    lean,
    stored,
    text_size,
)

_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_WORDS = bytes.maketrans(_MARKS + bytes(range(65, 91)), b" " * len(_MARKS) + bytes(range(97, 123)))
_CHUNK_WORDS = 1 << 17
# Changes of weights are added in whole steps of this fraction.
_STEPS = float(1 << 24)
# Words whose changes are added in one group.
_SLICE = 512
_LINES = 256
_PACKED = "part int, ids binary, sizes binary, toxic binary, langs array<string>"
_SUMS = "name string, sums binary"


@dataclass(frozen=True)
class Network:
    buckets: int = 1 << 15
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 16
    part_bytes: int = 8_000_000
    rounds: int = 3
    epochs: int = 2  # of each part in each round
    batch: int = 48
    rate: float = 0.004
    languages: int = 64
    least_of_a_language: int = 40
    dropped: float = 0.2
    decay: float = 2e-4
    seed: int = 11


def word_ids(text: bytes, buckets: int) -> np.ndarray:
    """Three buckets of each word of a text, from 1; 0 is padding."""
    words = text.translate(_WORDS).split()
    out = np.empty((len(words), 3), np.int64)
    for j, parts in enumerate((words, [w[:4] for w in words], [w[:6] for w in words])):
        # The seeds keep a short word apart from a stem of the same letters.
        out[:, j] = np.fromiter(map(zlib.crc32, parts, itertools.repeat(j)), np.int64, len(words))
    return out % (buckets - 1) + 1


def laid_out(ids: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each followed by padding, and where their windows begin and end.

    A text's windows start at its words, or at its padding if it has none; with padding longer than the
    widest filter none reaches into the next text.
    """
    pad = np.zeros((gap, 3), np.int64)
    parts = [p for one in ids for p in (one, pad)]
    sizes = np.array([len(one) for one in ids], np.int64)
    starts = np.cumsum(sizes + gap) - sizes - gap
    return np.concatenate(parts), starts, starts + np.maximum(sizes, 1)


class Classifier:
    def __init__(self, net: Network) -> None:
        rng = np.random.default_rng(net.seed)
        self.net = net
        self.words = rng.normal(0, 0.02, (net.buckets, net.size)).astype(np.float32)
        self.words[0] = 0
        self.filters = {
            w: rng.normal(0, 0.3, (w, net.size, net.filters)).astype(np.float32) for w in net.widths
        }
        self.out = rng.normal(0, 0.1, len(net.widths) * net.filters).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.languages: list[str] = []
        self.by_language = np.zeros((net.buckets, 0), np.float32)
        self.thresholds = np.zeros(1)
        self.constant: float | None = None

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        return self.words[ids[:, 0]] + self.words[ids[:, 1]] + self.words[ids[:, 2]]

    def peaks(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width, where each filter is largest in each text, and how large."""
        shape = (len(starts), self.net.filters)
        found = [(np.zeros(shape, np.int64), np.full(shape, -np.inf, np.float32)) for _ in self.net.widths]
        pieces: list[tuple[int, int, int]] = []

        def flush() -> None:
            first, last = pieces[0][1], pieces[-1][2]
            vectors = self.embedded(ids[first : last + max(self.net.widths) - 1])
            for w, (place, peak) in zip(self.net.widths, found, strict=True):
                total = sum(vectors[o : o + last - first] @ self.filters[w][o] for o in range(w))
                for text, a, b in pieces:
                    at = total[a - first : b - first].argmax(axis=0)
                    value = total[a - first + at, np.arange(shape[1])]
                    more = value > peak[text]
                    place[text, more], peak[text, more] = (a + at)[more], value[more]
            pieces.clear()

        for text, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            for a in range(start, end, _CHUNK_WORDS):
                pieces.append((text, a, min(end, a + _CHUNK_WORDS)))
                if pieces[-1][2] - pieces[0][1] >= _CHUNK_WORDS:
                    flush()
        if pieces:
            flush()
        return found

    def pooled(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each text."""
        out = []
        n = len(ids) - max(self.net.widths) + 1
        vectors = self.embedded(ids)
        for w in self.net.widths:
            total = sum(vectors[o : o + n] @ self.filters[w][o] for o in range(w))
            edges = np.stack([starts, ends], axis=1).ravel()
            out.append(np.maximum.reduceat(total, edges, axis=0)[::2])
        return np.concatenate(out, axis=1)

    def raw(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Output before the threshold, and the number of the guessed language."""
        return self.raw_of_words((word_ids(text, self.net.buckets) for text in texts), len(texts))

    def raw_of_words(self, texts: Iterable[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        values, spoken = np.zeros(n), np.zeros(n, np.int64)
        gap = max(self.net.widths) + 1
        part: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            # A text longer than a chunk comes in several parts; its filters take the largest.
            ids, starts, ends = laid_out(part, gap)
            peaks = self.pooled(ids, starts, ends)
            sums = np.add.reduceat(self.by_language[ids[:, 1]], starts, axis=0)
            rows, first = np.unique(owner, return_index=True)
            peaks = np.maximum(np.maximum.reduceat(peaks, first, axis=0), 0)
            values[rows] = peaks @ self.out + self.bias[0]
            if len(self.languages):
                spoken[rows] = np.add.reduceat(sums, first, axis=0).argmax(axis=1)
            part.clear()
            owner.clear()

        held = 0
        for i, ids in enumerate(texts):
            for at in range(0, max(1, len(ids)), _CHUNK_WORDS):
                # With the first words of what follows, so that no window is lost.
                part.append(ids[at : at + _CHUNK_WORDS + gap - 2])
                owner.append(i)
            held += len(ids)
            if held >= _CHUNK_WORDS:
                flush()
                held = 0
        if part:
            flush()
        return values, spoken

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        values, spoken = self.raw(texts)
        return 1 / (1 + np.exp(-np.clip(values - self.thresholds[spoken], -30, 30)))

    def train(self, ids: list[np.ndarray], labels: np.ndarray, seed: tuple[int, ...] = ()) -> None:
        """Adam over mini-batches; only the words under each filter's peak get a gradient."""
        net = self.net
        rng = np.random.default_rng([net.seed + 1, *seed])
        state: dict = {}
        step = 0

        def update(name, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
            m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            m[rows] = 0.9 * m[rows] + 0.1 * grad
            v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
            fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            value[rows] -= net.rate * fix * m[rows] / (np.sqrt(v[rows]) + 1e-7)

        gap, k = max(net.widths) + 1, net.filters
        for _ in range(net.epochs):
            for rows in self.batches(ids, rng.permutation(len(ids))):
                step += 1
                # Words left out at random keep the filters from resting on single texts.
                seen = [ids[r][rng.random(len(ids[r])) >= net.dropped] for r in rows]
                flat, starts, ends = laid_out(seen, gap)
                found = self.peaks(flat, starts, ends)
                places, peaks = [place for place, _ in found], [peak for _, peak in found]
                peak = np.concatenate(peaks, axis=1)
                shown = np.maximum(peak, 0)
                p = 1 / (1 + np.exp(-np.clip(shown @ self.out + self.bias, -30, 30)))
                error = ((p - labels[rows]) / len(rows)).astype(np.float32)
                back = error[:, None] * self.out * (peak > 0)
                touched, changes = [], []
                for j, w in enumerate(net.widths):
                    g = back[:, j * k : (j + 1) * k]
                    grad = np.zeros_like(self.filters[w])
                    for o in range(w):
                        at = places[j] + o
                        grad[o] = np.einsum("bfd,bf->df", self.embedded(flat[at].reshape(-1, 3)).reshape(*at.shape, net.size), g)
                        change = (g[:, :, None] * self.filters[w][o].T).reshape(-1, net.size)
                        for one in flat[at].reshape(-1, 3).T:
                            touched.append(one)
                            changes.append(change)
                    update(w, self.filters[w], grad)
                update("out", self.out, shown.T @ error + 1e-4 * self.out)
                update("bias", self.bias, error.sum(keepdims=True))
                words, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(words), net.size), np.float32)
                np.add.at(grad, inverse, np.concatenate(changes))
                grad += net.decay * self.words[words]
                grad[words == 0] = 0
                update("words", self.words, grad, words)

    def batches(self, ids: list[np.ndarray], order: np.ndarray) -> Iterator[np.ndarray]:
        """Texts in groups of ``batch``, or fewer once they hold ``_CHUNK_WORDS`` words."""
        begin = held = 0
        for i, r in enumerate(order):
            held += len(ids[r])
            if i + 1 - begin == self.net.batch or held >= _CHUNK_WORDS or i + 1 == len(order):
                yield order[begin : i + 1]
                begin, held = i + 1, 0

    def changes(self, before: Classifier, rows: int) -> Iterator[tuple[str, np.ndarray]]:
        """What training on ``rows`` rows changed, in whole steps, each with its weight behind it."""

        def steps(new: np.ndarray, old: np.ndarray) -> np.ndarray:
            return np.rint((new.astype(np.float64) - old) * _STEPS).astype(np.int64)

        moved = steps(self.words, before.words)
        touched = moved.any(axis=1).astype(np.int64)
        both = np.column_stack([moved, touched])
        for at in np.unique(np.flatnonzero(touched) // _SLICE).tolist():
            yield f"words {at}", both[at * _SLICE : (at + 1) * _SLICE].ravel()
        dense = [("out", self.out, before.out), ("bias", self.bias, before.bias)]
        dense += [(f"filters {w}", self.filters[w], before.filters[w]) for w in self.net.widths]
        for name, new, old in dense:
            yield name, np.append(steps(new, old).ravel() * rows, rows)

    def move(self, name: str, sums: np.ndarray) -> None:
        """Take in the sum of all ``changes`` of one name."""
        kind, _, which = name.partition(" ")
        if kind == "words":
            of = sums.reshape(-1, self.net.size + 1)
            begin = int(which) * _SLICE
            self.words[begin : begin + len(of)] += of[:, :-1] / np.maximum(of[:, -1:], 1) / _STEPS
            return
        value = {"out": self.out, "bias": self.bias}.get(kind)
        value = self.filters[int(which)] if value is None else value
        value += (sums[:-1] / sums[-1] / _STEPS).reshape(value.shape)

    def learn_languages(self, ids: list[np.ndarray], names: list[str | None]) -> None:
        """Log-odds of each word bucket by language, to guess whose threshold holds."""
        found = Counter(n for n in names if n is not None)
        self.languages = sorted(sorted(found, key=lambda n: (-found[n], n))[: self.net.languages])
        counts = np.zeros((max(1, len(self.languages)), self.net.buckets), np.int64)
        for i, one in self.counted(ids, names):
            counts[i] += one
        self.weigh_languages(counts)

    def counted(self, ids: list[np.ndarray], names: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """How often each word bucket stands in the texts of a language, by the language's number."""
        for i, language in enumerate(self.languages):
            own = [one[:, 1] for one, name in zip(ids, names, strict=True) if name == language]
            if own:
                yield i, np.bincount(np.concatenate(own), minlength=self.net.buckets).astype(np.int64)

    def weigh_languages(self, counts: np.ndarray) -> None:
        smooth = counts.T + 0.5
        self.by_language = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        self.by_language[0] = 0

    def calibrate(self, texts: list[bytes], labels: np.ndarray) -> None:
        """The threshold with the least sum of error shares, that of clean texts weighed 1.5, by language."""
        values, spoken = self.raw(texts)
        self.draw_lines(values, spoken, (labels == 0).astype(np.int64), (labels == 1).astype(np.int64))

    def draw_lines(self, values: np.ndarray, spoken: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> None:
        """The thresholds from how many clean and toxic texts have each value and guessed language."""

        def best(own: np.ndarray) -> float:
            v, at = np.unique(values[own], return_inverse=True)
            good, bad = (np.bincount(at, weights=n[own]) for n in (clean, toxic))
            # Errors when the line is drawn before each value.
            missed = np.append(0, np.cumsum(bad)) / max(1, bad.sum())
            wrong = 1 - np.append(0, np.cumsum(good)) / max(1, good.sum())
            cut = np.flatnonzero(missed + 1.5 * wrong == (missed + 1.5 * wrong).min())
            edges = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
            return float(edges[cut[len(cut) // 2]])

        overall = best(np.ones(len(values), bool))
        self.thresholds = np.full(max(1, len(self.languages)), overall)
        for i in range(len(self.languages)):
            own = spoken == i
            if min(toxic[own].sum(), clean[own].sum()) >= self.net.least_of_a_language:
                self.thresholds[i] = best(own)


def _small(net: Network) -> type:
    return np.uint16 if net.buckets <= 1 << 16 else np.uint32


def packed(docs: DataFrame, marks: DataFrame, parts: int, net: Network) -> DataFrame:
    """Labelled rows dealt by a hash of the document; a row per part, with word ids.

    Texts are shuffled once: ``docs`` (keys, lang, text) and ``marks`` (key, toxic) meet in their part.
    """
    part = F.pmod(F.xxhash64(KEY, F.lit(net.seed)), F.lit(parts)).cast("int")
    dealt = [side.withColumn("part", part).repartition(parts, "part").groupBy("part") for side in (docs, marks)]

    def pack(docs: pa.Table, marks: pa.Table) -> pa.Table:
        known: dict[int, set[int]] = {}
        for key, toxic in zip(marks.column(KEY).to_pylist(), marks.column("toxic").to_pylist(), strict=True):
            known.setdefault(key, set()).add(toxic)
        langs = docs.column("lang").to_pylist()
        rows: dict[tuple[int, int, int], int] = {}
        for i, (key, tie) in enumerate(zip(*(docs.column(c).to_pylist() for c in KEYS), strict=True)):
            for toxic in known.get(key, ()):
                # Repeated rows count once, with the first language by name.
                j = rows.setdefault((key, tie, toxic), i)
                if langs[i] is not None and (langs[j] is None or langs[i] < langs[j]):
                    rows[key, tie, toxic] = i
        order = sorted(rows, key=lambda k: (zlib.crc32(f"{k[0]}/{k[1]}".encode()), k))
        if not order:
            return _arrow_packed().empty_table()
        text = docs.column("text")
        ids = [word_ids((text[rows[k]].as_py() or "").encode(), net.buckets).astype(_small(net)) for k in order]
        row = {
            "part": docs.column("part")[0].as_py(),
            "ids": b"".join(one.tobytes() for one in ids),
            "sizes": np.array([len(one) for one in ids], np.int64).tobytes(),
            "toxic": bytes(k[2] for k in order),
            "langs": [langs[rows[k]] for k in order],
        }
        give_back()
        return pa.table({name: [value] for name, value in row.items()}).cast(_arrow_packed())

    return dealt[0].cogroup(dealt[1]).applyInArrow(pack, _PACKED)


def _arrow_packed() -> pa.Schema:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()))
    return pa.schema(list(zip(("part", "ids", "sizes", "toxic", "langs"), kinds, strict=True)))


@dataclass(frozen=True)
class _Part:
    part: int
    ids: list[np.ndarray]
    toxic: np.ndarray
    langs: list[str | None]

    @property
    def held(self) -> np.ndarray:
        """Every third in the order of the keys' hash is kept back for the thresholds."""
        return np.arange(len(self.ids)) % 3 == 2

    def some(self, which: np.ndarray) -> list[np.ndarray]:
        return [self.ids[i] for i in np.flatnonzero(which)]


def _unpacked(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[_Part]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            flat = np.frombuffer(row["ids"], _small(net)).reshape(-1, 3)
            ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
            toxic = np.frombuffer(row["toxic"], np.uint8).astype(np.int64)
            yield _Part(row["part"], np.split(flat, ends[:-1]), toxic, row["langs"])


def _summed(
    parts: DataFrame, net: Network, of: Callable[[_Part], Iterable[tuple[str, np.ndarray]]]
) -> dict[str, np.ndarray]:
    """Sums of whole numbers by name, of all parts: of those of a task, then of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part in _unpacked(batches, net):
            for name, value in of(part):
                held[name] = held[name] + value if name in held else value
        if held:
            yield pa.RecordBatch.from_pydict({"name": list(held), "sums": [v.tobytes() for v in held.values()]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(one.as_py(), np.int64) for one in table.column("sums"))
        return pa.table({"name": table.column("name")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    added = parts.mapInArrow(lean(run), _SUMS).groupBy("name").applyInArrow(add, _SUMS)
    return {r["name"]: np.frombuffer(r["sums"], np.int64) for r in added.collect()}  # the network's size


def learn(docs: DataFrame, labels: DataFrame, net: Network = Network()) -> Classifier:
    """Train on ``docs`` (doc_id, text, lang) whose ``labels`` (doc_id, toxic) may be learned from."""
    rows = keyed(docs.where("doc_id IS NOT NULL"), "lang")
    marks = labels.where("toxic IN (0, 1)").select(
        F.col("doc_id").cast("bigint").alias(KEY), F.col("toxic").cast("int").alias("toxic")
    )
    sizes = rows.select(*KEYS, text_size()).join(marks, KEY).groupBy(*KEYS, "toxic").agg(F.max("_n").alias("_n"))
    totals = sizes.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("b")).collect()
    model = Classifier(net)
    if len(totals) < 2:
        model.constant = float(totals[0]["toxic"]) if totals else 0.0
        return model
    count = max(1, -(-sum(r["b"] for r in totals) // net.part_bytes))
    parts = stored(packed(rows, marks, count, net), "labelled")

    known = parts.select(F.explode("langs").alias("lang")).where("lang IS NOT NULL").groupBy("lang").count()
    frequent = known.orderBy(F.desc("count"), "lang").limit(net.languages).collect()
    model.languages = sorted(r["lang"] for r in frequent)
    _count_languages(parts, model)
    for number in range(net.rounds):
        _train_round(parts, model, number)
    _draw_lines(parts, model)
    return model


def _count_languages(parts: DataFrame, model: Classifier) -> None:
    net, slices = model.net, range(0, model.net.buckets, _SLICE)
    languages = model.languages

    def of(part: _Part) -> Iterator[tuple[str, np.ndarray]]:
        own = Classifier(net)
        own.languages = languages
        for i, counts in own.counted(part.ids, part.langs):
            for at in slices:
                yield f"{i} {at}", counts[at : at + _SLICE]

    counts = np.zeros((max(1, len(languages)), net.buckets), np.int64)
    for name, sums in _summed(parts, net, of).items():
        i, at = map(int, name.split())
        counts[i, at : at + _SLICE] = sums
    model.weigh_languages(counts)


def _train_round(parts: DataFrame, model: Classifier, number: int) -> None:
    """All parts train from the present weights, which then move by the mean of their changes."""
    shared = parts.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the network

    def of(part: _Part) -> Iterator[tuple[str, np.ndarray]]:
        own = copy.deepcopy(shared.value)
        ids = part.some(~part.held)
        own.train(ids, part.toxic[~part.held], (number, part.part))
        yield from own.changes(shared.value, len(ids))

    for name, sums in _summed(parts, model.net, of).items():
        model.move(name, sums)


def _draw_lines(parts: DataFrame, model: Classifier) -> None:
    """Thresholds from the outputs for all rows that were kept back."""
    shared = parts.sparkSession.sparkContext.broadcast(model)
    names = ("line", "spoken", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value
        for part in _unpacked(batches, ready.net):
            held = part.held if part.held.any() else np.ones(len(part.ids), bool)
            own = part.some(held)
            values, spoken = ready.raw_of_words(own, len(own))
            lines = np.rint(np.clip(values, -30, 30) * _LINES).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (lines, spoken, part.toxic[held])], names=names)

    judged = parts.mapInArrow(lean(run), ", ".join(f"{n} bigint" for n in names))
    counts = judged.groupBy("line", "spoken").agg(
        F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )
    found = np.array([tuple(r) for r in counts.collect()], np.int64)  # lines by languages
    model.draw_lines(found[:, 0] / _LINES, *found[:, 1:].T)


def score(docs: DataFrame, model: Classifier, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with score and predicted (named with ``prefix``)."""
    new = {f"{prefix}score": "double", f"{prefix}predicted": "int"}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value
        for batch in in_slices(batches, "text", 4 << 20):
            found = ready.scores(encoded(batch.column("text")))
            arrays = [pa.array(found, pa.float64()), pa.array(found >= 0.5).cast(pa.int32())]
            names = [*batch.schema.names, *new]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return docs.mapInArrow(lean(run), extended(docs.schema, **new))
