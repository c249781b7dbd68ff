"""Layers with holes and several parts, fold rules and components of any size."""

import json

from pyspark.sql import functions as F

from ridgewater.functions import geo
from ridgewater.operators import graph, sampling
from ridgewater.operators.scale import global_positions, running_totals
from ridgewater.sources import geojson


def ring(x, y, s, turn=1):
    points = [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    return points[::turn]


def layer(spark, tmp_path, features):
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(path)


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def test_multipolygons_come_back_and_holes_are_taken_off(spark, tmp_path):
    two = [[ring(80, 30, 0.2), ring(80.05, 30.05, 0.1)], [ring(81, 30, 0.2)]]
    path = layer(spark, tmp_path, [feature("MultiPolygon", two, id=1), feature("Polygon", two[0], id=2), feature("Polygon", [two[0][0], two[0][1][::-1]], id=3)])
    read = geojson.read_polygons(spark, path, "id")
    assert {r.polygon_id: r.parts for r in read.collect()} == {1: [0, 0, 1], 2: [0, 0], 3: [0, 0]}
    out = str(tmp_path / "out")
    geojson.write_layer(read, "districts", ["polygon_id"], out)
    back = geojson.read_polygons(spark, out, "polygon_id", lines=True)
    assert {r.polygon_id: (r.rings, r.parts) for r in back.collect()} == {r.polygon_id: (r.rings, r.parts) for r in read.collect()}
    area = {r.polygon_id: (r.area_ha, r.centroid_lon) for r in geo.polygon_measures(back).collect()}
    whole, hole, far = (geo.polygon_measures(spark.createDataFrame([(1, [[tuple(map(float, p)) for p in r]])], "polygon_id long, rings array<array<struct<x:double,y:double>>>")).first().area_ha
                        for r in (two[0][0], two[0][1], two[1][0]))
    assert abs(area[2][0] - (whole - hole)) < 1e-3 and abs(area[3][0] - area[2][0]) < 1e-6 and abs(area[1][0] - (whole - hole + far)) < 1e-3
    assert abs(area[2][1] - 80.1) < 1e-9


def test_first_watershed_of_an_id_is_kept(spark, tmp_path):
    path = layer(spark, tmp_path, [feature("Polygon", [ring(i, i, 1)], HYBAS_ID=7, UP_AREA=area) for i, area in enumerate((500, 20, 90))])
    assert [r.up_area_km2 for r in geojson.read_watersheds(spark, path).collect()] == [500.0]


def test_folds_by_one_rule(spark):
    df = spark.createDataFrame([(g,) for g, n in enumerate([9, 7, 5, 5, 3, 1]) for _ in range(n)], "g int")
    folds = {r.g: r.fold for r in sampling.balanced_folds(df, "g", 2).distinct().collect()}
    assert folds == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    years = spark.range(900).select((F.col("id") % 450).alias("year"))
    assert {r.fold for r in sampling.interleaved_folds(years, "year", 3).filter("year % 3 = 1").collect()} == {1}


def test_positions_and_totals_keep_large_whole_numbers_apart(spark):
    big = 2**53
    df = spark.createDataFrame([(1, big + i, 1) for i in range(40)], "g int, t long, n int").repartition(5)
    assert all(r.t - big == r.position for r in global_positions(df, [F.col("t")]).collect())
    assert all(r.t - big + 1 == r.s for r in running_totals(df, ["g"], "t", {"s": F.col("n")}).collect())


def test_components_end_only_when_nothing_changes(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.components(links).collect()} == {0}
