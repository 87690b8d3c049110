"""Points in outlines by the grid, against an all-pairs ray cast."""

import random

import numpy as np
import pytest

from chronika.functions import geo
from chronika.operators import spatial


def vertices(spark, rings):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, r in enumerate(rings) for i, (x, y) in enumerate(r)], "ring int, at int, lng double, lat double")


def cast(rings, lat, lng):
    """Even-odd ray cast to the east in each ring, unwrapped and closed through its pole; the point one turn east and west too."""
    out = set()
    for k, ring in enumerate(rings):
        r = geo.unwrapped(ring)
        x, y = r[:, 0], r[:, 1]
        x2, y2 = np.roll(x, -1), np.roll(y, -1)
        for p in (lng - 360, lng, lng + 360):
            with np.errstate(all="ignore"):
                if (((y > lat) != (y2 > lat)) & (p < (x2 - x) * (lat - y) / (y2 - y) + x)).sum() % 2:
                    out.add(k)
    return out


def blob(rng, x, y, size, n=40):
    angles = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(0.4, 1, n) * size
    return [((x + f * np.cos(a) + 180) % 360 - 180, max(-89, min(89, y + f * np.sin(a)))) for a, f in zip(angles, far)]


@pytest.mark.parametrize("cell", [0.5, 2.0, 7.5])
def test_grid_equals_ray_cast(spark, cell):
    rng = np.random.default_rng(5)
    rings = [blob(rng, x, y, s) for x, y, s in ((0, 0, 30), (10, 5, 3), (178, 40, 15), (-179, -20, 8), (90, 60, 25), (5, 5, 0.3))]
    rings.append([(x, -65 + rng.uniform(-6, 6)) for x in range(-180, 180, 10)])  # winds round the south pole
    rings.append([(x, 78 + rng.uniform(-4, 4)) for x in range(170, -180, -15)])  # and one round the north pole
    rings = [[*r, r[0]] for r in rings]
    points = [(i, float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-200, 200))) for i in range(3000)]
    points += [(10_000 + i, a, b) for i, (a, b) in enumerate([(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (45.0, 179.99)])]
    frame = spark.createDataFrame(points, "id int, lat double, lng double").repartition(3)
    found = {}
    for r in spatial.within(frame, spatial.ring_edges(vertices(spark, rings)), cell).collect():
        found.setdefault(r.id, set()).add(r.ring)
    want = {i: w for i, a, b in points if abs(a) < 90 and (w := cast(rings, a, (b + 180) % 360 - 180))} | {10_000: {7}, 10_001: {6}}
    assert {i: (found.get(i), want.get(i)) for i in found.keys() | want.keys() if found.get(i) != want.get(i)} == {}


def test_borders_and_grid_corners(spark):
    """A square along grid lines: its southern and western edges belong to it or not, but points inside and outside never err."""
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    points = [(i, a, b) for i, (a, b) in enumerate((a + d, b + e) for a in (0, 5, 10) for b in (0, 5, 10) for d in (-0.25, 0.25) for e in (-0.25, 0.25))]
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in points], "id int, lat double, lng double")
    inside = {r.id for r in spatial.within(frame, spatial.ring_edges(vertices(spark, [square]))).collect()}
    assert inside == {i for i, a, b in points if 0 < a < 10 and 0 < b < 10}


def test_tolerance_in_kilometres(spark):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    far = [(179.9, 60), (-179.9, 60), (-179.9, 61), (179.9, 61), (179.9, 60)]
    points = [(0, 5.0, 10.1), (1, 5.0, 10.2), (2, -0.13, 5.0), (3, -0.14, 5.0), (4, 60.5, -179.7), (5, 60.5, 179.5), (6, 60.5, 180.0), (7, 10.09, 10.09), (8, 10.1, 10.1), (9, None, 1.0), (10, float("nan"), 1.0), (11, 5.0, 5.0)]
    frame = spark.createDataFrame(points, "id int, lat double, lng double")
    land = {r.id: r.land for r in spatial.on_land(frame, spatial.ring_edges(vertices(spark, [ring, far])), 15.0).collect()}
    assert land == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 8: False, 9: False, 10: False, 11: True}
    bare = {r.id for r in spatial.on_land(frame, spatial.ring_edges(vertices(spark, [ring, far])), 0).filter("land").collect()}
    assert bare == {6, 11}


def test_near_edges_equal_all_pairs(spark):
    rng = random.Random(4)
    ring = blob(np.random.default_rng(1), 20, 70, 12, 60)
    points = [(i, 70 + rng.uniform(-14, 14), 20 + rng.uniform(-30, 30)) for i in range(800)]
    frame = spark.createDataFrame(points, "id int, lat double, lng double")
    got = {r.id for r in spatial.near_edges(frame, spatial.ring_edges(vertices(spark, [[*ring, ring[0]]])), 60.0, 0.25).collect()}
    want = set()
    for i, lat, lng in points:
        p = np.array([((x - lng) * 111.32 * np.cos(np.radians(lat)), (y - lat) * 110.57) for x, y in [*ring, ring[0]]])
        a, d = p[:-1], np.diff(p, axis=0)
        t = np.clip(-(a * d).sum(1) / (d * d).sum(1), 0, 1)
        if np.hypot(*(a + t[:, None] * d).T).min() <= 60:
            want.add(i)
    assert got == want and want


def test_no_rings_and_no_points(spark):
    none = spark.createDataFrame([], "id int, lat double, lng double")
    edges = spatial.ring_edges(vertices(spark, [[(0, 0), (1, 0), (1, 1)]]))
    assert spatial.on_land(none, edges).count() == 0
    one = spark.createDataFrame([(1, 0.5, 0.9)], "id int, lat double, lng double")
    assert [r.land for r in spatial.on_land(one, edges.limit(0)).collect()] == [False]


def test_copies_of_points_and_outlines_are_judged_once(spark):
    corners = [(r, i, x, y) for r in range(40) for i, (x, y) in enumerate([(10.0, 10.0), (14.0, 10.0), (14.0, 14.0), (10.0, 14.0), (10.0, 10.0)])]
    corners += [(100, i, x, y) for i, (x, y) in enumerate([(10.2, 10.2), (14.0, 10.0), (14.0, 14.0), (10.0, 14.0), (10.2, 10.2)])]
    edges = spatial.ring_edges(spark.createDataFrame(corners, "ring long, at int, lng double, lat double"))
    assert spatial.one_of_equal(edges).select("ring").distinct().count() == 2
    places = [(12.1, 12.3), (10.05, 10.1), (9.9, 12.0), (9.0, 12.0), (None, 1.0), (13.9, 13.9), (14.2, 12.0), (60.0, 12.0)]
    rows = [(i * 10 + n, lat, lng) for i, (lat, lng) in enumerate(places) for n in range(5)]
    points = spark.createDataFrame(rows, "id long, lat double, lng double")
    inside = {r.id for r in spatial.within(points, edges).collect()}
    near = {r.id for r in spatial.near_edges(points, edges, 30.0).collect()}
    assert 0 < len(inside) < len(inside | near) < len(rows)
    found = spatial.judged(points, edges, 30.0).collect()
    assert sorted((r.id, r.inside, r.land) for r in found) == sorted((i, i in inside, i in inside | near) for i, _, _ in rows)
