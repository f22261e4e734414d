"""The pivot search against all inner products."""

import math

import numpy as np
import pytest

from moodtide.llm import pivots


def plain(rows, top=20, step=20):
    vectors = [
        (i, [math.floor(64 * x) for x in v])
        for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a in {i for i, _ in vectors}:
        if a % step == 0:
            asked = min(q for i, q in vectors if i == a)
            scores = sorted((-sum(x * y for x, y in zip(asked, q)), b) for b, q in vectors if b != a)
            out += [(a, k + 1, b, -s) for k, (s, b) in enumerate(scores[:top])]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    return sorted(map(tuple, pivots.nearest(pivots.quantised(frame), **options).collect()))


@pytest.mark.parametrize("scale", [1.0, 1e3])
def test_clustered_vectors(spark, monkeypatch, scale):
    """Small blocks and many rings, clusters, many equal vectors and ties; all rounds are used."""
    monkeypatch.setattr(pivots, "BLOCK", 8)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    points = centres[rng.integers(0, 6, 400)] + 0.05 * rng.normal(size=(400, 8))
    points[100:160] = points[7]
    rows = [(i, [float(np.float32(x * scale)) for x in p], "r") for i, p in enumerate(points)]
    assert found(spark, rows) == plain(rows)


def test_hard_rows(spark):
    rows = [
        (0, [0.5, 0.25], "a"), (20, [0.5, 0.25], "a"), (20, [0.5, 0.25], "a"), (21, [-0.1, 2.0, 3.0], "a"), (22, None, "a"), (40, [None, 1.0], "a"),
        (41, [float("nan"), 1.0], "a"), (42, [float("inf"), 1.0], None), (None, [1.0, 1.0], "a"), (60, [], "a"), (61, [0.0, 0.0], "a"), (62, [0.0], "a"),
        (21, [9.0, 9.0], "a"),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [r for r in rows if r[0] == 0]) == []
    assert found(spark, [(0, None, "a")]) == []
    assert found(spark, []) == []


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(2**22 + i), float(2**22 - 3 * i)], "a") for i in range(45)]
    assert found(spark, rows) == plain(rows)


def test_bounds_leave_rings_out(spark, monkeypatch):
    """With tight clusters a query looks into few of the blocks."""
    monkeypatch.setattr(pivots, "BLOCK", 8)
    rng = np.random.default_rng(0)
    points = np.repeat(rng.normal(size=(8, 4)) * 10, 50, axis=0) + 0.01 * rng.normal(size=(400, 4))
    points /= np.linalg.norm(points, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in p * 8], "r") for i, p in enumerate(points)]
    asked = []
    real = pivots.written
    monkeypatch.setattr(pivots, "written", lambda df, name: asked.append((name, out := real(df, name))) or out)
    assert found(spark, rows) == plain(rows)
    rings = [df for name, df in asked if name == "pivot-blocks"][0].select("ring").distinct().count()
    pairs = sum(df.count() for name, df in asked if name == "pivot-pairs")
    assert pairs < 0.7 * rings * 20


def test_rows_that_repeat_an_id_are_all_candidates(spark):
    rows = [(20, [1.0, 0.0], "a"), (21, [1.0, 1.0], "a"), (21, [9.0, 9.0], "a"), (22, [2.0, 0.0], "a"), (20, [0.5, 2.0], "a"), (21, [9.0, 9.0], "a")]
    got = found(spark, rows)
    assert got == plain(rows) and got[0][2:] == (21, plain(rows)[0][3]) and len(got) == 4
    many = [(21, [float(i % 7), 1.0], "a") for i in range(300)] + [(i, [1.0, float(i % 5)], "a") for i in range(60)]
    assert found(spark, many) == plain(many)
