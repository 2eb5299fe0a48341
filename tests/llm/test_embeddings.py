"""Whitening and near-duplicates of embeddings against dense matrices."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rosterlab.llm import neighbour_graph, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component int, node string, x double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", 0.5) for r in rows], SCHEMA).repartition(3)


def usable(vector):
    return bool(vector) and all(c is not None and math.isfinite(c) for c in vector)


# ---- whitening


def check_whitening(spark, rows, how, d):
    got = whitening.whiten(frame(spark, rows), how).collect()
    kept = [(i, v) for i, v, *_ in rows if usable(v) and len(v) == d]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    own = (fit - sums / n) if n else fit
    values, vectors = np.linalg.eigh(own.T @ own / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(how.components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == len(kept) * k
    far = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    want = sorted((i if i is not None else -1, f) for (i, _), f in zip(kept, far))
    first = [r for r in got if r["component"] == 1]
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"]) for r in first) == want
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert max(r["identity_error"] for r in got) < 1e-9
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    return got, kept, x, n, sums, values, vectors


def test_whitening_follows_the_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    data = rng.standard_normal((300, 20)) * np.linspace(4, 0.3, 20) @ turn
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data.astype(np.float32))]
    rows += rows[:40] + [(900, None, 1), (901, [], 1), (902, [math.nan] * 20, 1), (903, [1.0] * 19 + [None], 2),
                         (904, [math.inf] * 20, 3), (905, [1.0] * 7, 3), (None, data[5].tolist(), None)]
    how = whitening.Whitening(components=6, block_numbers=200)
    got, kept, x, n, sums, values, vectors = check_whitening(spark, rows, how, 20)
    of = {i: r for (i, _), r in zip(kept, x)}
    for c in range(6):
        white = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        want = {i: float((r - sums / n) @ vectors[:, c] / np.sqrt(values[c])) for i, r in of.items()}
        sign = math.copysign(1, white[0] * want[0])
        assert max(abs(sign * white[i] - want[i]) for i in want) < 1e-9


def test_repeated_eigenvalues_keep_all_components(spark):
    """Corners of a cross polytope: all eigenvalues are equal, and one start vector spans a line."""
    corners = [[s * 2.0 * (i == j) for j in range(6)] for i in range(6) for s in (1, -1)]
    check_whitening(spark, [(i, c, 0) for i, c in enumerate(corners)], whitening.Whitening(), 6)


def test_lower_rank_and_one_vector(spark):
    line = [[float(i), 2.0 * i, 0.0, 1.0] for i in range(9)]
    got = whitening.whiten(frame(spark, [(i, v, 0) for i, v in enumerate(line)])).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    empty = whitening.whiten(frame(spark, [(1, None, 0)]))
    assert empty.count() == 0 and empty.columns == [c.split()[0] for c in whitening.OUT.split(", ")]


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[3_000_000, 1], [1, 2_999_999]], np.int64)
    sums = (3_000_001, 3_000_000)
    want = [sum((1000 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert whitening.deviations(x, 1000, sums) == want
    far = whitening.centred(x, 3, sums)
    assert far[0, 0] == float(Fraction(3 * 3_000_000 - 3_000_001, 3))


def test_bidiagonal_form_of_a_matrix():
    rng = np.random.default_rng(5)
    for matrix in (rng.standard_normal((30, 8)), np.diag([3.0, 3, 3, 2, 2, 0]), np.ones((4, 5))):
        product = lambda z: (matrix.T @ (matrix @ z), float((matrix @ z) @ (matrix @ z)))  # noqa: B023, E731
        right, form = whitening.bidiagonal(product, matrix.shape[1], 1)
        assert np.abs(right.T @ right - np.eye(matrix.shape[1])).max() < 1e-12
        assert np.abs(np.tril(form, -1)).max() == 0 or form.shape[0] < form.shape[1]
        assert np.allclose(form.T @ form, right.T @ matrix.T @ matrix @ right, atol=1e-10)


# ---- near-duplicates


def slow_links(rows, threshold=0.93):
    """(id, links, smallest id reached, kept) for each row, by all pairs."""
    unit = []
    for _, v, label in rows:
        fine = label is not None and usable(v) and any(v)
        unit.append(np.float32(v).astype(float) if fine else None)
    n = len(rows)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2]:
                continue
            if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def check_links(spark, rows, how):
    got = neighbour_graph.deduplicate(frame(spark, rows), how).collect()
    figures = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=repr)
    assert figures == slow_links(rows)
    return got


def clusters(rng, sizes, d, noise, label):
    rows = []
    for size in sizes:
        centre = rng.standard_normal(d)
        for _ in range(size):
            v = centre + noise * rng.standard_normal(d)
            rows.append((v * rng.uniform(0.5, 2)).astype(np.float32).tolist())
    return [(v, label(i)) for i, v in enumerate(rows)]


def test_links_of_groups_beyond_the_lists_and_tiles(spark):
    """Groups larger than a list, a leaf and a tile, and chains whose ends do not link."""
    rng = np.random.default_rng(7)
    made = clusters(rng, [1] * 120 + [2] * 30 + [3, 9, 40, 90], 24, 0.12, lambda i: i % 7 == 0)
    arc = [[math.cos(a), math.sin(a)] + [0.0] * 22 for a in np.arange(0, 5, 0.3)]
    rows = [(i * 3, v, int(label)) for i, (v, label) in enumerate(made + [(v, 5) for v in arc])]
    how = neighbour_graph.Descent(list_size=4, most_listed=8, leaf=8, tile=32, bucket=64, orders=3)
    got = check_links(spark, rows, how)
    assert got[0]["recall"] >= how.recall


def test_odd_vectors(spark):
    v = [0.3, -0.2, 0.9]
    rows = [
        (1, v, 1), (1, v, 1), (1, [9.0, 9.0, -9.0], 1), (2, [0.6, -0.4, 1.8], 1), (3, v, 2), (4, v, None), (5, None, 1),
        (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [0.3, None, 0.9], 1), (9, [math.nan, 0.1, 0.2], 1), (10, v + [0.0], 1),
        (11, [math.inf, 0.0, 0.0], 1), (None, [-0.1, 0.5, 0.1], 3), (None, [-0.1, 0.5, 0.1], 3), (0, [1e30, 1e30, 0.0], 4),
        (12, [1e-30, 1e-30, 0.0], 4), (13, [0.0, -0.0, 1.0], 6), (14, [-0.0, 0.0, 1.0], 6),
    ]
    check_links(spark, rows, neighbour_graph.Descent())
    assert neighbour_graph.deduplicate(frame(spark, rows).limit(0)).count() == 0
    assert neighbour_graph.deduplicate(frame(spark, [(5, None, 1)])).collect()[0]["kept"]


def test_a_group_with_a_third_of_all_rows(spark):
    """Repeated vectors are one node; near ones fill lists that stop growing."""
    rng = np.random.default_rng(9)
    made = clusters(rng, [150], 16, 0.05, lambda i: 1) + clusters(rng, [1] * 150, 16, 0.0, lambda i: 1)
    rows = [(i, v, label) for i, (v, label) in enumerate(made)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)]
    check_links(spark, rows, neighbour_graph.Descent(list_size=4, most_listed=16, tile=64, bucket=128))


def test_thinned_names_and_audit(spark):
    """A low recall doubles the lists; what the audit finds is added."""
    rng = np.random.default_rng(4)
    rows = [(i, v, 0) for i, (v, _) in enumerate(clusters(rng, [2] * 12, 16, 0.1, lambda i: 0))]
    how = neighbour_graph.Descent(list_size=2, most_listed=2, reverse=1, orders=1, leaf=3, audited=200, recall=1.0)
    check_links(spark, rows, how)
