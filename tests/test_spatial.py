"""Neighbours and overlays against brute force."""

import math
import random

import numpy as np
import pytest

from gridmend.functions import scalar as s
from gridmend.operators import spatial


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * s.RADIUS_ASIN_KM * math.asin(math.sqrt(min(1.0, x)))


def world(n, seed):
    rng = random.Random(seed)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)] + [(89.9, 10.0), (-89.99, -170.0), (0.0, 180.0), (0.0, -180.0), (90.0, 0.0), (-90.0, 5.0)]
    return spots + [(30 + rng.gauss(0, 2), -95 + rng.gauss(0, 2)) for _ in range(n)] + [(30.0, -95.0)] * 40


@pytest.mark.parametrize("k", [1, 3])
def test_neighbours(spark, k, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 4)
    points, queries = world(60, 1), [*world(15, 2), (30.0, -95.0), (30.0, 85.0)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(9999, None, 1.0)], "id int, lat double, lon double")
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(queries)] * 2 + [(777, 1.0, None)], "query int, lat double, lon double")
    got = {}
    for r in spatial.neighbours(q, p, k).collect():
        got.setdefault(r.query, []).append((r.km, r.id))
    assert set(got) == set(range(len(queries)))
    for i, x in enumerate(queries):
        want = sorted((km(x, y), j) for j, y in enumerate(points))
        same = {}
        for d, j in want:
            same.setdefault(points[j], []).append((d, j))
        kept = sorted(d for group in same.values() for d in group[:k])[:k]
        found = sorted(got[i])
        assert [d for d, _ in found] == pytest.approx([d for d, _ in kept], abs=1e-6)
        if k == 1:
            assert found[0][1] in {j for d, j in want if d <= want[0][0] + 1e-9}


def test_neighbours_within(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 4)
    points, queries = world(80, 3), world(10, 4)
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id int, lat double, lon double")
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(queries)], "query int, lat double, lon double")
    for reach in (150.0,):
        got = sorted((r.query, r.id) for r in spatial.neighbours(q, p, within_km=reach).collect())
        assert got == [(i, j) for i, x in enumerate(queries) for j, y in enumerate(points) if km(x, y) <= reach]


def test_no_neighbours(spark):
    p = spark.createDataFrame([], "id int, lat double, lon double")
    q = spark.createDataFrame([(1, 2.0, 3.0)], "query int, lat double, lon double")
    assert spatial.neighbours(q, p).count() == 0 and spatial.neighbours(q.where("false"), q.withColumnRenamed("query", "id")).count() == 0


def star(cx, cy, r, n, seed):
    rng = random.Random(seed)
    return [[cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)] for i in range(n)]


def inside(rings, x, y):
    hit = np.zeros(np.broadcast(x, y).shape, bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ax != bx:
                hit ^= ((np.minimum(ax, bx) <= x) & (x < np.maximum(ax, bx))) & (ay + (by - ay) * (x - ax) / (bx - ax) > y)
    return hit


BOX = (0.0, 0.0, 10.0, 10.0)
SHAPES = {
    1: [[[1, 1], [9, 1], [9, 9], [1, 9]], [[3, 3], [3, 7], [7, 7], [7, 3]]],  # a frame
    2: [star(5, 5, 4.5, 23, 1)],
    3: [star(3, 6, 2.5, 11, 2)[::-1]],
    4: [[[0, 0], [10, 0], [10, 10], [0, 10]]],
    5: [[[1, 1], [9, 1], [9, 2], [2, 2], [2, 8], [9, 8], [9, 9], [1, 9]]],  # a C
    6: [[[4.5, 4.5], [5.5, 4.5], [5.5, 5.5], [4.5, 5.5]]],
    7: [[[2, 2], [2, 2], [3, 3]]],
}


def shapes(spark, ids):
    rows = [(i, [[list(map(float, p)) for p in r] for r in SHAPES[i]]) for i in ids]
    return spark.createDataFrame(rows, "id int, rings array<array<array<double>>>")


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_shared_areas(spark, depth):
    got = {(r.a, r.b): r.area for r in spatial.shared_areas(shapes(spark, SHAPES), shapes(spark, SHAPES), BOX, depth).collect()}
    whole = {r.id: r.area for r in spatial.areas(shapes(spark, SHAPES)).collect()}
    assert whole[1] == 48 and whole[4] == 100 and whole[7] == 0
    side = (np.arange(1500) + 0.5) / 150
    raster = {i: inside(rings, side[:, None], side[None, :]) for i, rings in SHAPES.items()}
    for a in SHAPES:
        for b in SHAPES:
            assert got.get((a, b), 0.0) == pytest.approx((raster[a] & raster[b]).mean() * 100, abs=0.05), (a, b)
        assert got.get((a, 4), 0.0) == pytest.approx(whole[a], abs=1e-9)
    assert got[1, 4] == pytest.approx(48) and (1, 6) not in got and got[5, 1] == pytest.approx(8 + 6 + 8)


def test_shares_of_clipped_polygons(spark):
    got = {r.id: (r.area, r.inside) for r in spatial.clipped_shares(shapes(spark, [1, 5, 6]), shapes(spark, [1]), BOX).collect()}
    assert got[1] == pytest.approx((48, 48)) and got[6] == (1.0, 0.0) and got[5] == pytest.approx((22, 22))


def test_points_in_polygons(spark):
    rng = random.Random(8)
    at = [(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(600)] + [(1.0, 1.0), (9.0, 9.0), (3.0, 3.0), (5.0, 5.0), (0.0, 0.0), (10.0, 10.0), (0.625, 0.625)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "point int, x double, y double")
    got = {(r.point, r.id) for r in spatial.holders(points, shapes(spark, SHAPES), BOX).collect()}
    want = {(i, k) for i, (x, y) in enumerate(at) for k, rings in SHAPES.items() if 0 <= x <= 10 and 0 <= y <= 10 and inside(rings, np.array(x), np.array(y))}
    assert got == want


def test_points_and_shapes_that_repeat_are_compared_once(spark, monkeypatch):
    """Counts are those of all pairs; what is compared are different places and different shapes."""
    square = [[[1.0, 1.0], [5.0, 1.0], [5.0, 5.0], [1.0, 5.0]]]
    far = [[[6.0, 6.0], [9.0, 6.0], [9.0, 9.0]]]
    polygons = spark.createDataFrame([(1, square), (2, square), (3, far), (3, square)], "id int, rings array<array<array<double>>>")
    points = spark.createDataFrame([(i, 2.0 + (i % 2) * 20, 2.0) for i in range(40)] + [(40, 8.5, 7.0), (40, 8.5, 7.0)], "point int, x double, y double")
    compared, real = [], spatial.holders

    def counted(p, s, *more):
        compared.append((p.count(), s.select("id").distinct().count()))
        return real(p, s, *more)

    monkeypatch.setattr(spatial, "holders", counted)
    got = {tuple(r) for r in spatial.holder_counts(points, polygons, BOX).collect()}
    assert got == {(1, 20), (2, 20), (3, 21)}
    assert compared == [(3, 2)]
