"""Hard negatives against a brute-force version; the bounds lose nothing."""

import math

import numpy as np
import pytest
from pyspark.sql import Row

from veracity.llm import hard_negatives as hn

VECS = "vec_id long, embedding array<double>, label long"


def clean(rows):
    out = set()
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        out.add((i, tuple(math.floor(256 * x) for x in v), label))
    return list(out)


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=False)), -2**63), 2**63 - 1)


def brute(rows, every=100, positives=5, top=10):
    rows, out = clean(rows), []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        scored = [(dot(a[1], r[1]), r[0], r[2]) for r in rows if r is not a]
        for ps, pid, _ in sorted((s for s in scored if s[2] == a[2]), key=key)[:positives]:
            fit = [s for s in scored if s[2] != a[2] and 30 * ps <= 100 * s[0] <= 90 * ps]
            out += [(a[0], pid, k, s[1], ps, s[0]) for k, s in enumerate(sorted(fit, key=key)[:top], 1)]
    return sorted(out, key=str)


def mined(spark, rows, **kw):
    return sorted((tuple(r) for r in hn.mine_hard_negatives(spark.createDataFrame(rows, VECS), **kw).collect()), key=str)


def vectors(seed, n, dims=8, spread=0.05, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return [(i, (centres[rng.integers(clusters)] + rng.normal(size=dims) * spread).tolist(), int(rng.integers(4)))
            for i in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 60)
    monkeypatch.setattr(hn, "ANCHORS", 12)


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.02), (2, 2.0)])
def test_equals_brute_force(spark, small_blocks, seed, spread):
    rows = vectors(seed, 400, spread=spread)
    got = mined(spark, rows, every=10)
    assert got == brute(rows, every=10) and got


def test_odd_rows(spark, small_blocks):
    rows = vectors(3, 150, dims=4, spread=0.1)
    rows += [(200, None, 1), (210, [1.0, None, 0.0, 0.0], 1), (220, [float("nan")] * 4, 2), (230, [float("inf"), 0.0, 0.0, 0.0], 2),
             (240, [1.0, 0.5, 0.0, 0.0], None), (250, [], 1), (260, [0.5, 0.5], 1), (270, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], 2),
             (280, [1e30, -1e30, 3.0, 1e200], 0), (290, [-0.0, 0.0, 0.0, 0.0], 3), (-100, [0.4, 0.1, -0.3, 0.2], 1),
             (None, [0.4, 0.1, -0.3, 0.2], 1), (300, [1e308, 0.0, 0.0, 0.0], 0)]
    rows += [(400 + i, [0.7, 0.1, 0.1, -0.2], i % 3) for i in range(60)]  # one common vector: ties by id
    rows += rows[:20] * 4 + [rows[100]] * 50                                 # repeated rows
    got = mined(spark, rows, every=10)
    assert got == brute(rows, every=10) and len(got) == len(set(got))


def test_fewer_rows_than_asked(spark):
    assert mined(spark, [(0, [1.0, 0.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.95, 0.0], 2), (4, [-1.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows) == [(0, 1, 1, 2, 65536, 32768)]


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    rows = vectors(5, 120)
    wide = spark.createDataFrame([Row(vec_id=i, embedding=v, label=y, block=1, uid=2, vector="x", rank=3, score=4)
                                  for i, v, y in rows])
    got = sorted((tuple(r) for r in hn.mine_hard_negatives(wide, every=10).collect()), key=str)
    assert got == brute(rows, every=10)


def test_tree_is_minimal_and_bounds_prune():
    rng = np.random.default_rng(7)
    points = np.floor(rng.normal(size=(40, 3)) * 100)
    order, parent, edge = hn.spanning_tree(points)
    assert sorted(order) == list(range(40)) and all(p < k for k, p in enumerate(parent))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    joined, total = {0}, 0.0
    while len(joined) < 40:  # plain Prim
        w, j = min((d[i, j], j) for i in joined for j in range(40) if j not in joined)
        joined.add(j)
        total += w
    assert abs(total - sum(edge)) < 1e-6
    # anchors close together against long rows: the child's window needs few exact scores
    near = np.floor(np.array([1000.0, 0, 0]) + rng.normal(size=(30, 3)) * 5)
    rows = np.floor(rng.normal(size=(5000, 3)) * 300)
    order, parent, edge = hn.spanning_tree(near)
    tree = hn.Tree(near[order], np.array(parent), np.array(edge), rows)
    for k, at, exact in tree.walk(lambda k, low, high: high >= hn.kth_largest(low, 5)):
        full = rows @ near[order[k]]
        assert set(hn.first_rows(full.astype(np.int64), np.arange(5000), 5)) <= set(at.tolist())
        assert np.array_equal(exact, full[at].astype(np.int64))
    assert tree.rescored < 5000 * 30 / 10
