"""Nearest binary codes against all pairs, for vectors of several widths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlab.llm import binary_search


def slow_nearest(rows, asked, k):
    bits = max((len(v) for _, v in rows if v is not None), default=0)
    own = set()
    for i, v in rows:
        if i is not None and v is not None:
            code = tuple(c is not None and c > 0 for c in v)
            own.add((i, code + (False,) * (bits - len(code))))
    out = []
    for i, code in own:
        if asked(i):
            others = sorted((sum(a != b for a, b in zip(code, c)), j, c) for j, c in own if (j, c) != (i, code))
            out += [(i, rank + 1, j, d) for rank, (d, j, _) in enumerate(others[:k])]
    return sorted(out)


def check(spark, rows, how, every=5):
    vectors = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, code int, query string"
    )
    got = binary_search.nearest(vectors.repartition(3), F.col("vec_id") % every == 0, how)
    assert sorted(map(tuple, got.collect())) == slow_nearest(rows, lambda i: i % every == 0, how.k)


@pytest.mark.parametrize("d", [7, 96, 130])
def test_all_dimensions_count(spark, d):
    """Neighbours that differ in the last dimensions only, a code of a third of the rows, repeated ids."""
    rng = np.random.default_rng(d)
    base = rng.standard_normal((12, d))
    rows = []
    for i in range(90):
        v = base[i % 12].copy()
        flips = rng.choice(d, size=min(d, i % 9), replace=False)
        v[flips if i % 2 else -1 - np.arange(min(d, i % 9))] *= -1
        rows.append((i, v.astype(np.float32).tolist()))
    rows += [(100 + i, rows[0][1]) for i in range(40)]
    rows += [(5, rows[7][1]), (5, rows[8][1]), (5, rows[5][1]), (None, rows[3][1]), (200, None)]
    rows += [(205, rows[4][1][:3]), (210, [None] * d), (215, [])]
    check(spark, rows, binary_search.Search(k=6))


def test_segments_follow_the_entries():
    how = binary_search.Search()
    assert binary_search.Cut.of(64, 51_282, how) == binary_search.Cut(64, 16)
    assert binary_search.Cut.of(64, 30_000_000, how).segments == 3
    assert binary_search.Cut.of(1024, 1_000_000, how).width == 20
    assert binary_search.Cut.of(64, 500, how).segments == 8
    assert binary_search.Cut.of(3, 10, how).segments == 1
