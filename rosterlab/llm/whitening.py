"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Every entry c of a usable vector becomes the whole number floor(scale * c) + shift. The fit list is
each different whole vector once. Its rows, centred by the exact column sums S (n*x - S, then divided
by n), are the matrix X, which stays distributed in packed blocks of rows.

X is brought to upper bidiagonal form B by alternating products: a pass over the blocks forms
y = Xv - beta*u for the block's rows and adds up X'y and y'y, so one pass a step gives both the new left
vector's length and the next right vector. A left vector is kept as the coefficients z with u = Xz, d
numbers however many rows there are, so the full reorthogonalisation of both sides is arithmetic on
d-vectors: u_i'y = z_i'(X'y). Where the correction of a left vector is not small the pass is made again
with the corrected direction. If a step ends in nothing (an invariant subspace, a lower rank, equal
eigenvalues) it goes on with a new direction orthogonal to all earlier ones, until the right vectors
span the space; so repeated eigenvalues keep all their components. The SVD of the small B then gives
components and deviations: eigenvalues are sigma^2/n, eigenvectors the right vectors times B's.

Of the data only sums of d+1 numbers a task are shuffled, and d+1 numbers come to the driver a pass.
There are d passes (64 for 64 dimensions).

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors
whose length differs from the most frequent one (of equally frequent lengths the larger counts). Repeated
rows and ids each get their result; a null vec_id stays null. Components whose deviation is nothing
(``least_ratio`` of the largest) cannot be whitened and are left out: fewer than ``components`` are returned
for a lower rank, and none for one different vector. An empty table gives no rows. A whole number
or deviation that does not fit 64 bits is an error, never a wrong number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import lean, stored

_LONG = (1 << 63) - 1
OUT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
    "identity_error double"
)


@dataclass(frozen=True)
class Whitening:
    scale: int = 64
    shift: int = 1_000_000
    components: int = 16
    least_ratio: float = 1e-9
    block_numbers: int = 1 << 18  # entries in a packed block of rows
    seed: int = 11


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: its size, column sums, and the components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    directions: np.ndarray  # a unit column per component
    trace: float
    identity_error: float


def whole_vectors(vectors: DataFrame, how: Whitening) -> DataFrame:
    """(vec_id, x) of the rows that can be used, all of one length."""
    entry_fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c")
    ).where((F.size("c") > 0) & F.forall("c", lambda c: F.coalesce(entry_fits(c), F.lit(False))))
    lengths = usable.groupBy(F.size("c").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    whole = lambda c: F.floor(c * F.lit(float(how.scale))) + F.lit(how.shift).cast("bigint")
    return usable.where(F.size("c") == (most["d"] if most else 0)).select(
        "vec_id", F.transform("c", whole).alias("x")
    )


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers, all of one length."""
    numbers = column.flatten().to_numpy(zero_copy_only=False)
    return numbers.reshape(len(column), -1)


def packed(x: DataFrame, how: Whitening) -> DataFrame:
    """The different vectors of ``x`` in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = as_matrix(batch.column("x"))
            step = max(1, how.block_numbers // max(1, rows.shape[1]))
            blocks = [rows[i : i + step].astype("<i8").tobytes() for i in range(0, len(rows), step)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["rows"])

    return stored(x.select("x").distinct().mapInArrow(lean(run), "rows binary"), "fit")


def totals(blocks: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> list:
    """Sum of ``part`` (a fixed number of figures) over all blocks."""
    kind = pa.int64() if whole else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for block in batch.column("rows"):
                own = part(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d))
                own = np.array(own, object) if whole else own
                sums = own if sums is None else sums + own
        if sums is not None:
            places = pa.array(range(len(sums)), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array(sums.tolist(), kind)], names=["at", "part"])

    parts = blocks.mapInArrow(lean(run), f"at int, part {'bigint' if whole else 'double'}")
    found = parts.groupBy("at").agg(F.sum("part").alias("part")).collect()
    return [r["part"] for r in sorted(found, key=lambda r: r["at"])]


def numerators(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n*x - S, exactly; Python numbers where 64 bits are too few."""
    largest = max(1, int(np.abs(x).max(initial=0)))
    if n * largest < _LONG // 2 and max(map(abs, sums), default=0) < _LONG // 2:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return numerators(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over the dimensions of (n*x - S)^2, exactly."""
    far = numerators(x, n, sums)
    if far.dtype == object or np.abs(far).max(initial=0) > isqrt(_LONG // far.shape[1]):
        return (far.astype(object) ** 2).sum(axis=1).tolist()
    return (far * far).sum(axis=1).tolist()


def bidiagonal(
    product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (columns) and B with X V = U B for orthonormal U; ``product(z)`` is (X'Xz, |Xz|^2)."""
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    left = np.zeros((0, d))  # u_i = X left[i]
    back = np.zeros((0, d))  # X'u_i
    columns: list[dict[int, float]] = []  # entries of B
    tiny = 64 * np.finfo(float).eps

    def clear(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for w in right:
                v = v - (w @ v) * w
        return v

    def fresh() -> np.ndarray:
        while True:
            v = clear(rng.standard_normal(d))
            size = np.linalg.norm(v)
            if size > 1e-3:
                return clear(v / size) / np.linalg.norm(clear(v / size))

    v, beta, largest = fresh(), 0.0, 0.0
    for _ in range(d):
        before = len(left) - 1
        right.append(v)
        column = {before: beta} if beta else {}
        z = v - beta * left[before] if beta else v.copy()
        g, length = product(z)
        for _ in range(3):
            c = left @ g
            if c @ c <= 1e-12 * max(length, tiny * largest**2):
                z, g, length = z - c @ left, g - c @ back, length - c @ c
                break
            z = z - c @ left
            g, length = product(z)
        alpha = float(np.sqrt(max(0.0, length)))
        largest = max(largest, alpha)
        if alpha <= tiny * largest:
            # No new left vector: all of Xv lies among the earlier ones.
            columns.append(column)
            if len(right) < d:
                v, beta = fresh(), 0.0
            continue
        left = np.vstack([left, z / alpha])
        back = np.vstack([back, g / alpha])
        columns.append(column | {len(left) - 1: alpha})
        if len(right) == d:
            break
        rest = clear(back[-1] - alpha * v)
        beta = float(np.linalg.norm(rest))
        if beta <= tiny * largest:
            v, beta = fresh(), 0.0
        else:
            v = clear(rest / beta)
            v /= np.linalg.norm(v)
    form = np.zeros((len(left), len(right)))
    for j, column in enumerate(columns):
        for i, entry in column.items():
            form[i, j] = entry
    return np.array(right).T, form


def fit(x: DataFrame, how: Whitening) -> Fit | None:
    """Components of the different vectors among ``x``; None without any."""
    blocks = packed(x, how)
    first = blocks.first()
    if first is None:
        return None
    d = x.select(F.size("x").alias("d")).first()["d"]
    figures = totals(
        blocks, d, lambda rows: [len(rows), *(int(c) for c in rows.sum(axis=0, dtype=object))], whole=True
    )
    n, sums = figures[0], tuple(figures[1:])

    def product(z: np.ndarray) -> tuple[np.ndarray, float]:
        def part(rows: np.ndarray) -> np.ndarray:
            own = centred(rows, n, sums)
            y = own @ z
            return np.append(own.T @ y, y @ y)

        found = np.array(totals(blocks, d, part))
        return found[:-1], float(found[-1])

    right, form = bidiagonal(product, d, how.seed)
    _, sigma, turned = np.linalg.svd(form, full_matrices=False)
    directions = right @ turned.T
    trace = float((sigma**2).sum() / n)
    kept = [i for i, s in enumerate(sigma[: how.components]) if s > how.least_ratio * max(sigma[0], 0) > 0]
    directions, values = directions[:, kept], sigma[kept] ** 2 / n
    k = len(kept)
    error = 0.0
    if k:
        turn = directions / np.sqrt(values)

        def spread(rows: np.ndarray) -> np.ndarray:
            own = centred(rows, n, sums) @ turn
            return np.append((own.T @ own).ravel(), own.sum(axis=0))

        found = np.array(totals(blocks, d, spread)) / n
        mean = found[k * k :]
        error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return Fit(n, sums, values, directions, trace, error)


def whiten(vectors: DataFrame, how: Whitening | None = None) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    how = how or Whitening()
    x = whole_vectors(vectors, how)
    found = fit(x, how)
    if found is None or not len(found.eigenvalues):
        return vectors.sparkSession.createDataFrame([], OUT)
    k = len(found.eigenvalues)
    turn = found.directions / np.sqrt(found.eigenvalues)
    explained = found.eigenvalues / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, how.block_numbers // max(k, len(found.sums)))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                rows = as_matrix(batch.column("x"))
                m = len(rows)
                white = centred(rows, found.n, found.sums) @ turn
                each = np.repeat(np.arange(m), k)
                far = pa.array(deviations(rows, found.n, found.sums), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, found.n, np.int64)),
                        far.take(pa.array(each)),
                        pa.array(white.ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, found.identity_error)),
                    ],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    return x.mapInArrow(lean(run), OUT)
