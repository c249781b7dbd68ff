import math
import random

import pytest
from pyspark.sql import functions as F

from ridgewater.functions import geo
from ridgewater.operators import scale, spatial


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(a))


def inside(lon, lat, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > lat) != (by > lat) and lon < (bx - ax) * (lat - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def outline_km(lon, lat, rings):
    best = math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            dx, dy = bx - ax, by - ay
            t = max(0, min(1, ((lon - ax) * dx + (lat - ay) * dy) / (dx * dx + dy * dy)))
            best = min(best, haversine(lat, lon, ay + t * dy, ax + t * dx))
    return best


def blob(rng, cx, cy, size, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + size * rng.uniform(0.4, 1) * math.cos(a), cy + size * rng.uniform(0.4, 1) * math.sin(a)) for a in angles]


@pytest.fixture(scope="module")
def layer(spark):
    rng = random.Random(5)
    shapes = {}
    for i in range(12):
        cx, cy = rng.uniform(78, 80), rng.uniform(29, 31)
        rings = [blob(rng, cx, cy, rng.uniform(0.05, 0.6), rng.randint(5, 40))]
        if i % 3 == 0:
            rings.append(blob(rng, cx, cy, 0.02, 6))
        shapes[i] = rings
    classes = ["LOW", "MODERATE", "SIGNIFICANT", "EXTREME"]
    rows = [(i, classes[i % 4], [[(x, y) for x, y in r] for r in rings]) for i, rings in shapes.items()]
    df = spark.createDataFrame(rows, "polygon_id long, hazard_class string, rings array<array<struct<x:double,y:double>>>")
    pts = [(i, rng.uniform(28.7, 31.3), rng.uniform(77.6, 80.4)) for i in range(400)]
    return shapes, df, pts, spark.createDataFrame(pts, "point_id long, lat double, lon double")


def test_containment_matches_even_odd(layer):
    shapes, polygons, pts, points = layer
    want = {(i, p) for i, lat, lon in pts for p, rings in shapes.items() if inside(lon, lat, rings)}
    for size in (0.07, 0.15, 0.5):
        got = {tuple(r) for r in spatial.containing_polygons(points, polygons, size).collect()}
        assert got == want
    assert want


def test_classify_matches_brute_force(layer):
    shapes, polygons, pts, points = layer
    got = {r.point_id: r for r in spatial.classify(points, polygons, keep_far=True).collect()}
    assert len(got) == len(pts)
    for i, lat, lon in pts:
        hits = [p for p, rings in shapes.items() if inside(lon, lat, rings)]
        km = {p: outline_km(lon, lat, rings) for p, rings in shapes.items()}
        row = got[i]
        if hits:
            assert row.exact and row.km == 0 and row.polygon_id == min(hits)
        else:
            near = min(km, key=km.get)
            assert not row.exact and abs(row.km - km[near]) < 1e-6
            assert row.polygon_id == (near if km[near] <= 15 else None)


def test_ground_distance_beats_degree_distance(spark):
    # East is nearer on the ground although north is nearer in degrees.
    def box(x, y):
        return [[(x, y), (x + 0.01, y), (x + 0.01, y + 0.01), (x, y + 0.01)]]

    rows = [(1, "LOW", box(79.0105, 30.0)), (2, "EXTREME", box(78.99, 30.0098))]
    polygons = spark.createDataFrame(rows, "polygon_id long, hazard_class string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 30.0005, 79.0005), (2, 20.0, 72.0)], "point_id long, lat double, lon double")
    got = {r.point_id: r for r in spatial.classify(points, polygons).collect()}
    assert got[1].hazard_class == "LOW" and got[1].km < 0.98
    assert got[2].hazard_class is None and not got[2].exact


def test_split_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(tuple(r) for r in left.join(right, "k").select("id", "k", "v").collect())
    hot = scale.hot_keys(left, ["k"], 100)
    assert hot.filter("k = 0").first()["_splits"] > 1
    got = scale.spread_join(left, right, ["k"], "id", min_rows=100, max_rows=5)
    assert sorted(tuple(r) for r in got.select("id", "k", "v").collect()) == want


def test_nearest_k_with_copies(spark):
    rng = random.Random(2)
    targets = [(i, rng.uniform(29, 31), rng.uniform(78, 80)) for i in range(60)] + [(100 + i, 30.0, 79.0) for i in range(40)]
    pts = [(i, rng.uniform(28, 32), rng.uniform(77, 81)) for i in range(80)]
    t = spark.createDataFrame(targets, "target_id long, lat double, lon double")
    p = spark.createDataFrame(pts, "point_id long, lat double, lon double")
    got = {}
    for r in spatial.nearest_k(p, t, 3).collect():
        got.setdefault(r.point_id, {})[r.rank] = r.target_id
    for i, lat, lon in pts:
        best = sorted((haversine(lat, lon, a, b), k) for k, a, b in targets)[:3]
        assert [got[i][n] for n in (1, 2, 3)] == [k for _, k in best]


def test_flooded_ratio_and_overlay(spark, layer):
    shapes, polygons, _, _ = layer
    rng = random.Random(9)
    segs = [(i, rng.uniform(78, 80), rng.uniform(29, 31), rng.uniform(78, 80), rng.uniform(29, 31)) for i in range(40)]
    df = spark.createDataFrame(segs, "segment_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.segment_id, r.polygon_id): r.ratio for r in spatial.flooded_ratio(df, polygons).collect()}
    met = {tuple(r) for r in spatial.segments_in_polygons(df, polygons).collect()}
    n = 4000
    for i, x1, y1, x2, y2 in segs:
        for p, rings in shapes.items():
            share = sum(inside(x1 + (k + 0.5) / n * (x2 - x1), y1 + (k + 0.5) / n * (y2 - y1), rings) for k in range(0, n, 4)) / (n / 4)
            assert abs(got.get((i, p), 0.0) - share) < 0.01
            if share > 0:
                assert (i, p) in met
    assert all(r == 0 or k in met for k, r in got.items())


def test_geometry_columns(spark):
    one = spark.range(1)
    e, n = geo.utm44(F.lit(30.0), F.lit(79.0))
    row = one.select(e.alias("e"), n.alias("n"), geo.compass(F.lit(30.0), F.lit(79.0), F.lit(30.0), F.lit(80.0)).alias("c"),
                     geo.rain_cell(F.lit(30.25), F.lit(79.04))[0].alias("r"), geo.block(F.lit(-0.1), F.lit(0.3))[0].alias("b")).first()
    assert abs(row.e - 307077.0) < 60 and abs(row.n - 3320469.0) < 60
    assert row.c == "E" and row.r in (302, 303) and row.b == 0
    square = spark.createDataFrame([(1, [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]])], "polygon_id long, rings array<array<struct<x:double,y:double>>>")
    clipped = geo.clip_to_box(square, 1.0, 1.0, 5.0, 5.0).first().rings[0]
    assert {(p.x, p.y) for p in clipped} == {(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)}
    thin = spark.createDataFrame([([(0.0, 0.0), (0.001, 0.0), (1.0, 0.0), (1.0, 1.0)],)], "r array<struct<x:double,y:double>>")
    assert len(thin.select(geo.thin_ring(F.col("r"), 0.01).alias("t")).first().t) == 3
    m = geo.polygon_measures(spark.createDataFrame([(1, [[(81.0, 30.0), (81.01, 30.0), (81.01, 30.01), (81.0, 30.01)]])], "polygon_id long, rings array<array<struct<x:double,y:double>>>")).first()
    assert abs(m.area_m2 - 111.2e3 * 0.01 * 96.4e3 * 0.01) / m.area_m2 < 0.01 and abs(m.centroid_lon - 81.005) < 1e-6


def test_representative_points_lie_inside(spark):
    """Concave, holed and two-part polygons, one with corners on the scan line; a flat one has no point."""
    ring = lambda *xy: [(float(x), float(y)) for x, y in xy]
    shapes = {
        1: [ring((0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4))],
        2: [ring((0, 0), (6, 0), (6, 6), (0, 6)), ring((1, 1), (5, 1), (5, 5), (1, 5))],
        3: [ring((0, 0), (2, 0), (2, 4), (0, 4)), ring((10, 0), (15, 0), (15, 4), (10, 4))],
        4: [ring((0, 0), (2, 2), (4, 0), (6, 2), (4, 4), (2, 2), (0, 4))],
        5: [ring((0, 1), (3, 1), (5, 1))],
    }
    df = spark.createDataFrame(list(shapes.items()), "polygon_id long, rings array<array<struct<x:double,y:double>>>")
    got = {r.polygon_id: (r.lon, r.lat) for r in geo.representative_points(df).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3] == (12.5, 2.0) and got[2][0] in (0.5, 5.5)

    def inside(x, y, rings):
        odd = False
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
                if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                    odd = not odd
        return odd

    assert all(inside(*p, shapes[i]) for i, p in got.items())


def test_background_sample_is_exact(spark):
    from ridgewater.operators import sampling

    square = [(78.0, 30.0), (79.0, 30.0), (79.0, 31.0), (78.0, 31.0)]
    region = spark.createDataFrame([(1, "r", [square])], "polygon_id long, name string, rings array<array<struct<x:double,y:double>>>")
    events = spark.createDataFrame([(1, 30.5, 78.5)], "event_id long, lat double, lon double")
    box = (77.0, 29.0, 80.0, 32.0)
    rows = sampling.background_points(events, region, box, 25, 90, away_km=20.0).collect()
    assert len(rows) == 25 == len({r.point_id for r in rows}) and max(r.point_id for r in rows) >= 90
    assert all(78 < r.lon < 79 and 30 < r.lat < 31 and math.hypot((r.lon - 78.5) * 95.7, (r.lat - 30.5) * 111) > 19 for r in rows)
    nowhere = (10.0, 10.0, 11.0, 11.0)
    assert sampling.background_points(events, region, nowhere, 3, 10, barren=2).collect() == []


def test_nearest_searches_by_place_and_by_density(spark, monkeypatch):
    """200 points at four places and 2,500 targets close together: searched once a place, near targets only."""
    targets = [(i, 30.0 + (i % 50) * 0.004, 78.0 + (i // 50) * 0.004) for i in range(2500)]
    spots = [(30.0501, 78.0502), (30.1011, 78.1507), (30.149, 78.02), (30.42, 78.1)]
    points = [(i, *spots[i % 4]) for i in range(200)] + [(200, None, 78.0)]
    p = spark.createDataFrame(points, "point_id long, lat double, lon double")
    t = spark.createDataFrame(targets, "target_id long, lat double, lon double")
    pairs, plain = [], spatial.spread_join

    def counted(*args, **kwargs):
        out = plain(*args, **kwargs)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spatial, "spread_join", counted)
    got = {(r.point_id, r["rank"]): r.target_id for r in spatial.nearest_k(p, t, 2, 60.0).collect()}
    by_grid = {r.point_id: r.target_id for r in spatial.nearest_on_grid(p, t).collect()}
    assert sum(pairs) < 20_000
    for i, (lat, lon) in enumerate(spots):
        near = sorted((haversine(lat, lon, y, x), k) for k, y, x in targets)[:2]
        flat = min((math.hypot((lon - x) * math.cos(math.radians(lat)), lat - y), k) for k, y, x in targets)
        for point in range(i, 200, 4):
            assert [got[point, 1], got[point, 2]] == [k for _, k in near]
            assert by_grid[point] == (flat[1] if flat[0] <= 0.3 else None)
    assert len(got) == 400 and len(by_grid) == 201 and by_grid[200] is None


def test_background_sample_sees_that_no_room_is_left(spark, monkeypatch):
    """Events everywhere: the covered cells show it, so no candidate is drawn."""
    from ridgewater.operators import sampling

    events = spark.createDataFrame([(20 * i + j, i * 0.01, j * 0.01) for i in range(20) for j in range(20)], "event_id long, lat double, lon double")
    corners = [(0.05, 0.05), (0.15, 0.05), (0.15, 0.15), (0.05, 0.15)]
    region = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in corners]])], "polygon_id long, rings array<array<struct<x:double,y:double>>>")
    drawn = []
    monkeypatch.setattr(sampling, "uniform", lambda *parts: drawn.append(parts) or F.lit(0.5))
    assert sampling.background_points(events, region, (0.0, 0.0, 0.2, 0.2), 5, 50).collect() == []
    assert len(drawn) <= 3


def test_clusters_compare_places_not_copies(spark, monkeypatch):
    """400 points at four places, and one without a position: each pair of places is compared once."""
    spots = [(30.0, 78.0), (30.028, 78.0), (30.05, 78.01), (30.5, 78.0)]
    points = [(i, *spots[i % 4]) for i in range(400)] + [(400, None, 78.0)]
    pairs, plain = [], spatial.spread_join

    def counted(*args, **kwargs):
        out = plain(*args, **kwargs)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spatial, "spread_join", counted)
    df = spark.createDataFrame(points, "point_id long, lat double, lon double")
    got = {r.point_id: r.cluster for r in spatial.distance_clusters(df, 0.03).collect()}
    assert got == {**{i: 3 if i % 4 == 3 else 0 for i in range(400)}, 400: 400}
    assert sum(pairs) <= 6


def test_segments_look_up_sides_only(spark):
    """Lines are repeated over the cells they touch and no others; polygons around a start count without a side met."""
    rng = random.Random(11)
    lines = [(i, rng.uniform(78, 80), rng.uniform(29, 31), rng.uniform(78, 80), rng.uniform(29, 31)) for i in range(60)]
    lines += [(60, 78.1, 29.3, 79.9, 29.3), (61, 78.3, 29.1, 78.3, 30.9), (62, 78.25, 29.25, 78.25, 29.25), (63, 79.0, 30.0, 78.0, 30.0 + 1e-12)]
    df = spark.createDataFrame(lines, "segment_id long, x1 double, y1 double, x2 double, y2 double")
    cells = lambda d: {(r.segment_id, r.cell_row, r.cell_col) for r in d.collect()}
    known = spatial.segment_cells(df, 0.15, ends=("x1", "y1", "x2", "y2")).filter("local")
    assert cells(spatial._touched_cells(df, 0.15)) == cells(known)
    box = [[{"x": x, "y": y} for x, y in ((78.0, 29.0), (79.0, 29.0), (79.0, 30.0), (78.0, 30.0))]]
    layer = spark.createDataFrame([(1, box)], "polygon_id long, rings array<array<struct<x:double,y:double>>>")
    hits = [r.segment_id for r in spatial.segment_hits(df, layer, touching=False).collect()]
    assert 62 in hits and {r.segment_id for r in spatial.segments_in_polygons(df, layer, touching=False).collect()} == set(hits)


def test_radius_join_compares_places_not_rows(spark, monkeypatch):
    """Forty points at two places and nine targets at three: six places are compared, every pair of rows comes out."""
    at = [(30.0, 79.0), (30.1, 79.1)]
    near = [(30.0, 79.0), (30.05, 79.05), (31.0, 79.0)]
    points = spark.createDataFrame([(i, *at[i % 2]) for i in range(40)] + [(99, None, 79.0)], "point_id long, lat double, lon double")
    targets = spark.createDataFrame([(i, *near[i % 3]) for i in range(9)], "target_id long, lat double, lon double")
    compared, within = [], spatial.within_radius

    def counted(a, b, radius):
        compared.append((a.filter("lat IS NOT NULL").count(), b.count()))
        return within(a, b, radius)

    want = {(r.point_id, r.target_id): round(r.km, 3) for r in within(points, targets, 15.0).collect()}
    monkeypatch.setattr(spatial, "within_radius", counted)
    rows = spatial.within_radius_by_place(points, targets, 15.0, 3).collect()
    assert {(r.point_id, r.target_id): r.km for r in rows} == want and len(rows) == len(want) == 40 * 6
    assert compared == [(2, 3)]
