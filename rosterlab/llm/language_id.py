"""Language identification by prediction by partial matching.

For each language the bytes that follow each context of up to ``order`` bytes are counted, which
makes a context tree. A byte costs ``-log2(count / (n + t))`` bits in the longest context that was
seen with it (``n`` bytes, ``t`` different ones followed that context); on the way down each
context that was seen without it costs an escape, ``-log2(t / (n + t))``; at the end stand 256
equally likely bytes. Statistics are frozen after learning (no update, no exclusion), so
the cost of a byte depends on the ``order + 1`` bytes that end in it and a text's code length is
exact: the sum of table values. The language with the shortest code wins.

Learning uses a bounded sample of the labelled rows (``learn_rows`` and ``learn_bytes`` per
language, at most ``languages`` of them); every whole text is scored.

A null text, or one without a letter, is ``und`` with score 0. Without labelled rows every text
is ``und``. Of languages with equal code lengths the first by name wins. Rows are judged one by
one, so repeated rows get equal results and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import KEYS, encoded, extended, in_slices, keyed, lean, sampled_keys, text_size

UNKNOWN = "und"
_LETTER = regex.compile(rb"[A-Za-z]").search
_ANY_LETTER = regex.compile(r"\p{L}").search
_CHUNK = 1 << 18


@dataclass(frozen=True)
class Learning:
    order: int = 3
    learn_rows: int = 3000
    learn_bytes: int = 2_000_000
    languages: int = 64  # of more, each is learned from less
    score_bytes: int = 64  # the score weighs the lead as over so many bytes at most


def grams(text: np.ndarray, size: int) -> np.ndarray:
    """Each run of ``size`` bytes as one number; the last byte is the lowest."""
    n = len(text) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(size):
        out = out << np.uint64(8) | text[i : i + n]
    return out


class ContextTrees:
    """Code lengths in bits of every language, by context order."""

    def __init__(self, samples: dict[str, list[bytes]], order: int) -> None:
        self.names = sorted(samples)
        self.order = order
        pad = b"\n" * order
        joined = [
            np.frombuffer(b"".join(pad + t for t in samples[name]), np.uint8) for name in self.names
        ]
        # values[k]: what a run of k + 1 bytes costs; escapes[k]: what leaving its context costs.
        self.values: list[tuple[np.ndarray, np.ndarray]] = []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(order + 1):
            counted = [np.unique(grams(text, k + 1), return_counts=True) for text in joined]
            seen = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0, np.uint64)
            contexts, context_of = np.unique(seen >> np.uint64(8), return_inverse=True)
            # What the shorter context says, for languages that did not see the run here.
            cost = self._below(seen, k)
            escape = np.zeros((len(contexts), len(self.names)), np.float32)
            for j, (found, count) in enumerate(counted):
                at = np.searchsorted(seen, found)
                n = np.bincount(context_of[at], count, len(contexts))
                t = np.bincount(context_of[at], minlength=len(contexts))
                known = n > 0
                escape[known, j] = -np.log2(t[known] / (n[known] + t[known]))
                cost[:, j] += escape[context_of, j]
                cost[at, j] = -np.log2(count / (n + t)[context_of[at]])
            self.values.append((seen, cost))
            self.escapes.append((contexts, escape))

    def _below(self, runs: np.ndarray, k: int) -> np.ndarray:
        """Costs of runs of k + 1 bytes when their own context has been left."""
        if k == 0:
            return np.full((len(runs), len(self.names)), 8.0, np.float32)
        return self.cost(runs & np.uint64((1 << 8 * k) - 1), k - 1)

    def cost(self, runs: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each run of k + 1 bytes, a column for each language."""
        seen, values = self.values[k]
        at = np.minimum(np.searchsorted(seen, runs), max(0, len(seen) - 1))
        found = seen[at] == runs if len(seen) else np.zeros(len(runs), bool)
        if found.all() and len(runs):
            return values[at]
        out = np.zeros((len(runs), len(self.names)), np.float32)
        out[found] = values[at[found]]
        other = runs[~found]
        if len(other):
            contexts, escape = self.escapes[k]
            context = other >> np.uint64(8)
            where = np.minimum(np.searchsorted(contexts, context), max(0, len(contexts) - 1))
            known = contexts[where] == context if len(contexts) else np.zeros(len(other), bool)
            rest = self._below(other, k)
            rest[known] += escape[where[known]]
            out[~found] = rest
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.names)))
        pad = b"\n" * self.order
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (held == 0 or held + len(texts[end]) < _CHUNK):
                held += len(texts[end])
                end += 1
            part = texts[begin:end]
            sizes = np.array([len(t) for t in part], np.int64)
            joined = np.frombuffer(b"".join(pad + t for t in part), np.uint8)
            starts = np.cumsum(sizes + self.order) - sizes - self.order
            for at in range(0, len(joined) - self.order, _CHUNK):
                runs = grams(joined[at : at + _CHUNK + self.order], self.order + 1)
                cost = self.cost(runs, self.order)
                # The runs that end in the padding belong to no text.
                row = np.searchsorted(starts, np.arange(at, at + len(runs)), "right") - 1
                inside = at + np.arange(len(runs)) < starts[row] + sizes[row]
                cost[~inside] = 0
                first = np.flatnonzero(np.diff(row, prepend=-1))
                if len(first):
                    out[begin + row[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
            begin = end
        return out


def has_letter(text: bytes) -> bool:
    return bool(_LETTER(text)) or bool(_ANY_LETTER(text.decode()))


def learn(labelled: DataFrame, how: Learning = Learning()) -> ContextTrees:
    """Trees from the rows (``text``, ``lang``, ``doc_id``) that may be learned from."""
    rows = keyed(labelled.where("lang IS NOT NULL AND text IS NOT NULL"), "lang")
    sizes = rows.select("lang", *KEYS, text_size())
    keys = sampled_keys(sizes, "lang", how.learn_rows, how.learn_bytes, how.languages, every=True)
    chosen = rows.join(F.broadcast(keys), ["lang", *KEYS], "left_semi")  # learn_rows a language
    samples: dict[str, list[bytes]] = {}
    for r in sorted(chosen.select("lang", *KEYS, "text").distinct().collect()):
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return ContextTrees(samples, how.order)


def judged(texts: list[bytes], trees: ContextTrees, how: Learning) -> tuple[list, list, list]:
    """Language, score and bits per byte of each text."""
    if not trees.names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    bits = trees.bits(texts)
    best = bits.argmin(axis=1)
    size = np.maximum(1, [len(t) for t in texts])
    lead = bits - bits.min(axis=1, keepdims=True)
    weighed = lead * np.minimum(1, how.score_bytes / size)[:, None]
    score = 1 / np.exp2(-np.minimum(weighed, 1000)).sum(axis=1)
    rate = bits.min(axis=1) / size
    letter = [has_letter(t) for t in texts]
    return (
        [trees.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter, strict=True)],
        [s if ok else 0.0 for s, ok in zip(score.tolist(), letter, strict=True)],
        rate.tolist(),
    )


def identify(
    docs: DataFrame, trees: ContextTrees, how: Learning = Learning(), prefix: str = ""
) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and bits_per_byte (named with ``prefix``)."""
    new = {f"{prefix}lang_pred": "string", f"{prefix}score": "double"}
    new[f"{prefix}bits_per_byte"] = "double"
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the learning sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 4 << 20):
            found = judged(encoded(batch.column("text")), shared.value, how)
            types = (pa.string(), pa.float64(), pa.float64())
            arrays = [pa.array(x, t) for x, t in zip(found, types, strict=True)]
            names = [*batch.schema.names, *new]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return docs.mapInArrow(lean(run), extended(docs.schema, **new))
