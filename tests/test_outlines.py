"""Clipping to boundaries of any shape and thinning of shared borders."""

import random

import pytest
from pyspark.sql import functions as F

from ridgewater.functions import geo
from ridgewater.operators import outlines

POLYGON = "polygon_id long, rings array<array<struct<x:double,y:double>>>, parts array<int>"


def inside(x, y, rings):
    hit = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                hit = not hit
    return hit


def stretches(rings, y):
    xs = sorted(ax + (y - ay) * (bx - ax) / (by - ay) for r in rings for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]) if (ay > y) != (by > y))
    return list(zip(xs[::2], xs[1::2]))


def overlap(a, b, steps=4000):
    """Shared area by thin horizontal strips."""
    lo, hi = 0.0, 4.0
    h = (hi - lo) / steps
    total = 0.0
    for i in range(steps):
        y = lo + (i + 0.5) * h
        total += sum(max(0.0, min(q, s) - max(p, r)) for p, q in stretches(a, y) for r, s in stretches(b, y)) * h
    return total


def degrees2(clipped):
    """Area of clipped pieces in square degrees, holes taken off."""
    role = F.transform("parts", lambda p, i: F.when((i == 0) | (F.get("parts", i - 1) != p), 1).otherwise(-1))
    rings = clipped.select("polygon_id", "piece_id", F.posexplode(F.arrays_zip(F.col("rings").alias("ring"), role.alias("role"))).alias("n", "r"))
    edges = rings.select("polygon_id", "piece_id", "n", F.col("r.role").alias("role"), F.inline(geo.ring_edges(F.array("r.ring"))))
    each = edges.groupBy("polygon_id", "piece_id", "n", "role").agg((F.abs(F.sum(F.expr("ax * by - bx * ay"))) / 2).alias("a"))
    return {r[0]: r[1] for r in each.groupBy("polygon_id").agg(F.sum(F.expr("a * role"))).collect()}


STAR = [(0.3, 0.2), (2.0, 0.9), (3.6, 0.1), (2.9, 1.8), (3.8, 3.5), (2.1, 2.6), (0.2, 3.7), (1.0, 1.9)]
LAKE = [(1.6, 1.5), (2.3, 1.4), (2.1, 2.1)]


def test_clip_to_a_dented_boundary_with_a_hole(spark):
    rng = random.Random(5)
    shapes = []
    for i in range(12):
        cx, cy, s = rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0.2, 1.2)
        outer = [(cx - s, cy - s), (cx + s, cy - s * 0.8), (cx, cy), (cx + s * 0.9, cy + s), (cx - s, cy + s * 0.7)]
        hole = [(cx - s * 0.7, cy - s * 0.3), (cx - s * 0.4, cy - s * 0.3), (cx - s * 0.5, cy + s * 0.2)]
        shapes.append((i, [outer, hole] if i % 3 == 0 else [outer], [0, 0] if i % 3 == 0 else [0]))
    shapes.append((90, [[(9.0, 9.0), (9.1, 9.0), (9.0, 9.1)]], [0]))
    shapes.append((91, [], []))
    polygons = spark.createDataFrame(shapes, POLYGON)
    boundary = spark.createDataFrame([(1, [STAR + STAR[:1], LAKE], [0, 0])], POLYGON)
    got = degrees2(outlines.clip_to_boundary(polygons, boundary))
    for i, rings, _ in shapes:
        clipped_low = [[(x, y) for x, y in r] for r in rings]
        assert got.get(i, 0.0) == pytest.approx(overlap(clipped_low, [STAR, LAKE]), abs=2e-3)
    assert 90 not in got and 91 not in got and len(got) > 5
    assert outlines.clip_to_boundary(polygons, boundary.limit(0)).count() == 0


def test_pieces_cover_the_boundary_once(spark):
    boundary = spark.createDataFrame([(1, [STAR, LAKE], [0, 0])], POLYGON)
    windows = [[(p.x, p.y) for p in r.window] for r in outlines.convex_pieces(boundary).collect()]
    rng = random.Random(7)
    for _ in range(500):
        x, y = rng.uniform(0, 4), rng.uniform(0, 4)
        assert sum(inside(x, y, [w]) for w in windows) == int(inside(x, y, [STAR, LAKE]))


def test_small_remains_go(spark):
    polygons = spark.createDataFrame([(1, [[(80.0, 30.0), (80.01, 30.0), (80.01, 30.01), (80.0, 30.01)]], [0]), (2, [[(80.0199999, 30.0), (80.03, 30.0), (80.03, 30.0001)]], [0])], POLYGON)
    boundary = spark.createDataFrame([(1, [[(79.9, 29.9), (80.02, 29.9), (80.02, 30.2), (79.9, 30.2)]], [0])], POLYGON)
    left = outlines.clipped_measures(outlines.clip_to_boundary(polygons, boundary))
    whole = geo.polygon_measures(polygons.filter("polygon_id = 1")).first().area_m2
    assert [(r.polygon_id, round(r.area_m2)) for r in left.collect()] == [(1, round(whole))]


def test_box_keeps_parts_in_step(spark):
    far, near = [(9.0, 9.0), (9.1, 9.0), (9.0, 9.1)], [(0.1, 0.1), (0.4, 0.1), (0.1, 0.4)]
    row = geo.clip_to_box(spark.createDataFrame([(1, [far, near], [0, 1])], POLYGON), 0, 0, 1, 1).first()
    assert len(row.rings) == 1 and row.parts == [1]


def lattice(n, steps, rng):
    """n x n cells whose wavy borders have the same corners on both sides."""
    jitter = {}

    def at(x, y):
        key = (round(float(x), 6), round(float(y), 6))
        if key not in jitter:
            corner = abs(x - round(x)) < 1e-9 and abs(y - round(y)) < 1e-9
            jitter[key] = key if corner else (key[0] + rng.uniform(-0.02, 0.02), key[1] + rng.uniform(-0.02, 0.02))
        return jitter[key]

    cells = []
    for cx in range(n):
        for cy in range(n):
            walk = [(cx + i / steps, cy) for i in range(steps)] + [(cx + 1, cy + i / steps) for i in range(steps)]
            walk += [(cx + 1 - i / steps, cy + 1) for i in range(steps)] + [(cx, cy + 1 - i / steps) for i in range(steps)]
            ring = [at(x, y) for x, y in walk]
            cells.append((cx * n + cy, [ring + ring[:1] if (cx + cy) % 2 else ring[::-1]], [0]))
    return cells


def test_shared_borders_stay_shared(spark):
    cells = lattice(3, 8, random.Random(3))
    tiny = [(5.0, 5.0), (5.001, 5.0), (5.0, 5.001), (4.9995, 5.0005)]
    cells.append((50, [tiny], [0]))
    out = outlines.thin_shared(spark.createDataFrame(cells, POLYGON), 0.002)
    got = {r.polygon_id: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in out.collect()}
    assert set(got) == {c[0] for c in cells} and len(got[50][0]) == 3
    before = {frozenset((p, q)) for _, rings, _ in cells for p, q in zip(rings[0], rings[0][1:])}
    links = {}
    for i, rings in got.items():
        for p, q in zip(rings[0], rings[0][1:] + rings[0][:1]):
            links.setdefault(frozenset((p, q)), []).append(i)
    assert all(len(v) <= 2 for v in links.values()) and len(links) < len(before)
    # Inside the lattice every line has two owners: 12 inner borders, each unbroken.
    inner = [k for k, v in links.items() if len(v) == 2]
    assert {tuple(sorted(links[k])) for k in inner} == {(a, b) for a in range(9) for b in range(9) if b - a == 3 or (b - a == 1 and a % 3 < 2)}
    about = {}
    for k in links:
        p, q = tuple(k)
        about.setdefault(p, set()).add(q)
        about.setdefault(q, set()).add(p)
    for v, ws in about.items():  # nothing left to take
        if len(ws) == 2:
            a, b = ws
            area = abs((b[0] - a[0]) * (v[1] - a[1]) - (b[1] - a[1]) * (v[0] - a[0])) / 2
            assert area > 0.002 or b in about[a]
    junctions = {(float(x), float(y)) for x in range(4) for y in range(4)} - {(0.0, 0.0), (3.0, 0.0), (0.0, 3.0), (3.0, 3.0)}
    assert junctions <= set(about)
    total = lambda rings: sum(abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1]))) / 2 for r in rings)
    assert sum(total(r) for i, r in got.items() if i < 50) == pytest.approx(9, abs=0.5)


def test_what_lies_in_a_piece_is_left_as_it_is(spark):
    """A triangle inside keeps its corners in their order; one across the side is cut, one beside it has no row."""
    ring = lambda pts: [[{"x": x, "y": y} for x, y in pts]]
    boundary = spark.createDataFrame([(0, ring([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]), [0])], POLYGON)
    inner = [(0.2, 0.2), (0.4, 0.2), (0.3, 0.4)]
    rows = [(1, ring(inner), [0]), (2, ring([(x + 0.7, y) for x, y in inner]), [0]), (3, ring([(x + 0.85, y) for x, y in inner]), [0])]
    cut = {r.polygon_id: [(p.x, p.y) for p in r.rings[0]] for r in outlines.clip_to_boundary(spark.createDataFrame(rows, POLYGON), boundary).collect()}
    assert cut[1] == inner and set(cut) == {1, 2}
    assert max(x for x, _ in cut[2]) == 1.0
