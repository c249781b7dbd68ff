import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewater.functions import text as tx
from ridgewater.operators import quality as ql
from ridgewater.operators import raster as ra
from ridgewater.operators import rain as rn
from ridgewater.operators import reports as rp
from ridgewater.sources import geojson as gj
from ridgewater.sources import tables as tb


def square(x, y, s=1.0):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def test_geojson_layers(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"hazard": "low", "name": "Almora district", "admin_level": "5"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0)]}},
        {"type": "Feature", "properties": {"hazard": "EXTREME", "name": "X", "admin_level": "6"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(2, 2)], [square(5, 5)]]}},
        {"type": "Feature", "properties": {"hazard": "LOW"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"hazard": "LOW"}, "geometry": None},
        {"type": "Feature", "properties": {"hazard": "other"}, "geometry": {"type": "Polygon", "coordinates": [square(9, 9)]}},
    ]
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = {r.hazard_class: r.rings for r in gj.read_hazard_polygons(spark, str(path)).collect()}
    assert set(got) == {"LOW", "EXTREME"} and len(got["EXTREME"]) == 2 and got["LOW"][0][1].x == 1.0
    assert [r.name for r in gj.read_districts(spark, str(path)).collect()] == ["Almora"]
    assert [(r.lat, r.lon) for r in gj.read_points(spark, str(path)).collect()] == [(2.0, 1.0)]
    bare = tmp_path / "bare.geojson"
    bare.write_text(json.dumps({"type": "Polygon", "coordinates": [square(0, 0)]}))
    assert gj.read_polygons(spark, str(bare)).count() == 1
    with pytest.raises(ValueError):
        gj.write_layer(gj.read_polygons(spark, str(bare)), "secrets", [], str(tmp_path / "x"))


CURRENT = "event_id,event_date,latitude,longitude,location_accuracy,landslide_trigger,landslide_category,fatality_count,event_title"


def test_catalogue_layouts_and_cascade(spark, tmp_path):
    rows = ["1,2014-07-01,0.5,0.5,5km,Rain,slide,2,a", "2,07/02/2014 12:00:00 AM,0.5,0.5,exact,downpour,slide,,b", "3,2014-07-03,0.5,0.5,50km,rain,slide,,c",
            "4,2014-07-03,0.5,0.5,unknown,rain,slide,,d", "5,2014-07-03,0.5,0.5,1km,earthquake,slide,,e", "6,2014-07-03,1.5,1.5,1km,rain,slide,,f"]
    new = tmp_path / "new.csv"
    new.write_text("\n".join([CURRENT, *rows]))
    old = tmp_path / "old.csv"
    old.write_text("\n".join(["id,date,latitude,longitude,location_accuracy,trigger,landslide_type,fatalities,nearest_places", *rows]))
    district = spark.createDataFrame([(1, "D", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]])], "polygon_id long, name string, rings array<array<struct<x:double,y:double>>>")
    ql_box, ql.BOX = ql.BOX, (0, 2, 0, 2)
    for path in (new, old):
        frame = tb.read_catalogue(spark, str(path))
        shifted = frame.withColumn("lat", F.col("lat") + 29.0).withColumn("lon", F.col("lon") + 78.0)
        moved = district.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p.x + 78.0).alias("x"), (p.y + 29.0).alias("y")))))
        kept, counts = ql.select_catalogue(shifted, moved)
        assert {r.reason: r.n for r in counts.collect()} == {"kept": 2, "dropped_location_too_coarse": 2, "dropped_trigger_earthquake": 1, "outside": 1}
        assert {r.day for r in kept.collect()} == {dt.date(2014, 7, 1), dt.date(2014, 7, 2)}
    ql.BOX = ql_box
    bad = tmp_path / "bad.csv"
    bad.write_text("id,when\n1,2")
    with pytest.raises(ValueError):
        tb.read_catalogue(spark, str(bad))


def test_inventory_and_rain_records(spark, tmp_path):
    inv = tmp_path / "inv.csv"
    inv.write_text('UEI,Start Date,End Date,Main Cause,Human fatality,Districts,District_LGD_Codes\n'
                   'a,14-06-2013 00:00,30-06-2013 00:00,Flash flood and avalanche,9,"X, Y","1,2"\nb,bad,,rain,1,X,1\nc,01-07-2013 00:00,,Glacier break,1,"X,Y",1\n'
                   'd,01-07-2013 00:00,,landslide,1,Uttar Kashi Kashi,\n')
    codes = spark.createDataFrame([("1", "One"), ("2", "Two")], "code string, district string")
    got = {(r.event_id, r.district): r for r in tb.read_inventory(spark, str(inv), codes).collect()}
    assert set(got) == {("a", "One"), ("a", "Two"), ("d", "Uttarkashi")}
    assert got["a", "One"].end == dt.date(2013, 6, 20) and got["a", "One"].kind == "rain" and got["d", "Uttarkashi"].kind == "landslide"
    folder = tmp_path / "era"
    folder.mkdir()
    for i, (lat, year) in enumerate([(30.0, 2001), (30.25, 2001), (30.0, 2002)]):
        (folder / f"{i}.json").write_text(json.dumps({"district": "D", "lat": lat, "lon": 79.0, "year": year, "start": f"{year}-05-27T00:00", "precipitation_mm": [1.0, None, 2.0]}))
    rows = rn.read_point_years(tb.read_rain_records(spark, str(folder))).collect()
    assert len(rows) == 6 and {r.year for r in rows} == {2001} and sum(r.mm is None for r in rows) == 2


def test_cap_documents(spark, tmp_path):
    def doc(ident, msg, refs="", expires="2030-01-01T00:00:00+05:30", area="Chamoli"):
        info = "".join(f"<info><language>{lang}</language><severity>Severe</severity><expires>{expires}</expires><headline>{h}</headline>"
                       f"<area><areaDesc>{area}</areaDesc></area></info>" for lang, h in (("hi-IN", "बाढ़"), ("en-IN", "Flood")))
        return (f'<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>{ident}</identifier><sender>s</sender><sent>t</sent><status>Actual</status>'
                f"<msgType>{msg}</msgType><references>{refs}</references>{info}</alert>")

    path = tmp_path / "cap.xml"
    path.write_text("<feed>" + doc("1", "Alert") + doc("2", "Update", "s,1,t") + doc("3", "Cancel", "s,4,t") + doc("4", "Alert") + doc("5", "Alert", expires="2001-01-01T00:00:00")
                    + doc("6", "Alert", area="Uttarakhand") + "</feed>", encoding="utf-8")
    warnings = tb.read_cap(spark, str(path))
    assert warnings.filter("headline = 'Flood' AND headline_hi = 'बाढ़'").count() == 6
    now = {r.identifier: r for r in rp.current_warnings(warnings, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert set(now) == {"2", "6"} and now["2"].districts == ["Chamoli"] and now["6"].statewide and len(now["6"].districts) == 13


def test_text_rules(spark):
    row = spark.range(1).select(
        tx.cause_class(F.lit("Extreme rain, avalanches reported")).alias("a"), tx.cause_class(F.lit("glacier breaks off")).alias("b"),
        tx.accuracy_km(F.lit("Exact")).alias("c"), tx.accuracy_km(F.lit("25km")).alias("d"), tx.accuracy_km(F.lit("unknown")).alias("e"),
        tx.fold(F.lit("Joshīmath")).alias("f"), tx.network_key(F.lit("2001:db8::1")).alias("g"), tx.network_key(F.lit("1.2.3.4")).alias("h"),
        tx.indian_mobile(F.lit("098765-43210")).alias("i"), tx.names_in(F.lit("Heavy rain in पौड़ी and Tehri")).alias("j"),
        tx.is_emergency_hospital(F.lit("City Diagnostics")).alias("k"), tx.is_emergency_hospital(F.lit("Raj Hospital and Diagnostic Centre")).alias("l"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("rain", "glacier", 0.0, 25.0, None)
    assert row.f == "joshimath" and row.g == "2001:db8:0:0::/64" and row.h == "1.2.3.4" and row.i == "+919876543210"
    assert row.j == ["Pauri Garhwal", "Tehri Garhwal"] and not row.k and row.l


def test_terrain(spark):
    rng = np.random.default_rng(4)
    z = rng.permutation(14 * 15).reshape(14, 15).astype(float)
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(14) for c in range(15)], "row long, col long, z double")
    down = {}
    for r in range(14):
        for c in range(15):
            best = max((((z[r, c] - z[i, j]) / np.hypot(i - r, j - c), -i, -j) for i in range(max(0, r - 1), min(14, r + 2)) for j in range(max(0, c - 1), min(15, c + 2))
                        if z[i, j] < z[r, c]), default=None)
            if best:
                down[r, c] = (-best[1], -best[2])
    acc = {(r, c): 0 for r in range(14) for c in range(15)}
    for cell in acc:
        while cell is not None:
            acc[cell] += 1
            cell = down.get(cell)
    assert {(r.row, r.col): r.cells for r in ra.flow_accumulation(cells, "z").collect()} == acc
    for r in ra.focal_mean(cells, "z", 2, tile=4).collect():
        win = z[max(0, r.row - 2):r.row + 3, max(0, r.col - 2):r.col + 3]
        assert abs(r.focal_mean - win.mean()) < 1e-9


def test_codes_and_soil(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 5.33, 10.0, None)], "v double").withColumn("c", ra.encode(F.col("v")))
    assert [r.c for r in df.collect()] == [25, 133, 250, 255]
    assert df.filter(F.abs(ra.decode(F.col("c")) - F.col("v")) > 0.02).count() == 0
    rows = [(10.0, 45.0, "D"), (40.0, 22.0, "C"), (60.0, 10.0, "A"), (30.0, 10.0, "B"), (None, 10.0, None)]
    soil = spark.createDataFrame(rows, "s double, c double, want string")
    assert soil.filter(~ra.soil_group(F.col("s"), F.col("c")).eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("half, tile", [(12, 16), (25, 256), (3, 2)])
def test_percentile_over_tiles(spark, half, tile):
    rng = np.random.default_rng(half)
    grid = rng.integers(0, 30, (45, 61)).astype(float)
    grid[rng.random(grid.shape) < 0.1] = np.nan
    rows = [(r - 20, c - 7, None if np.isnan(z) else float(z)) for (r, c), z in np.ndenumerate(grid)]
    cells = spark.createDataFrame(rows, "row long, col long, z double")
    got = {(r.row + 20, r.col + 7): r.percentile for r in ra.elevation_percentile(cells, "z", half, tile).collect()}
    assert len(got) == int((~np.isnan(grid)).sum())
    for (r, c), share in got.items():
        window = grid[max(0, r - half) : r + half + 1, max(0, c - half) : c + half + 1]
        assert abs(share - (window < grid[r, c]).sum() / (~np.isnan(window)).sum() * 100) < 1e-9
    assert ra.elevation_percentile(cells.limit(0), "z", half, tile).count() == 0


def brute_merge(grid, smallest):
    label, sizes = np.full(grid.shape, -1), {}
    around = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
    inside = lambda r, c: 0 <= r < grid.shape[0] and 0 <= c < grid.shape[1]
    for start in np.ndindex(grid.shape):
        if label[start] >= 0:
            continue
        name, todo, label[start] = start[0] * 1000 + start[1], [start], start[0] * 1000 + start[1]
        sizes[name] = 0
        while todo:
            r, c = todo.pop()
            sizes[name] += 1
            for a, b in ((r + i, c + j) for i, j in around):
                if inside(a, b) and label[a, b] < 0 and grid[a, b] == grid[r, c]:
                    label[a, b] = name
                    todo.append((a, b))
    touched = {}
    for r, c in np.ndindex(grid.shape):
        touched.setdefault(label[r, c], set()).update(label[r + i, c + j] for i, j in around if inside(r + i, c + j))
    out = grid.copy()
    for name in sizes:
        at, seen = name, set()
        while sizes[at] < smallest and at not in seen and touched[at] - {at}:
            seen.add(at)
            at = max(touched[at] - {at}, key=lambda g: (sizes[g], -g))
        if sizes[at] >= smallest:
            out[label == name] = grid[at // 1000, at % 1000]
    return out


@pytest.mark.parametrize("kinds, smallest", [(2, 8), (4, 8), (6, 12)])
def test_small_groups_and_holes_merge(spark, kinds, smallest):
    rng = np.random.default_rng(kinds)
    grid = rng.integers(0, kinds, (24, 30))
    grid[2:12, 2:12] = 1
    grid[5:7, 5:7] = 0
    rows = [(r, c, int(k)) for (r, c), k in np.ndenumerate(grid)]
    got = ra.merge_small(spark.createDataFrame(rows, "row long, col long, kind long"), "kind", smallest).collect()
    want = brute_merge(grid, smallest)
    assert len(got) == grid.size and all(r.kind == want[r.row, r.col] for r in got) and (want[5:7, 5:7] == 1).all()
