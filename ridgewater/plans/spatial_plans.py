"""Registered queries on spatial joins and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgewater.functions import geo
from ridgewater.operators import spatial
from ridgewater.plans import views as v


def _round(df, *cols, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


def point_in_polygon(spark, sf):
    out = spatial.point_in_polygon(v.points(spark, sf), v.polygons(spark, sf))
    return out.select("point_id", "polygon_id")


def nearest_polygon(spark, sf):
    return _round(spatial.classify(v.points(spark, sf), v.polygons(spark, sf)), "km")


def nearest_polygon_any(spark, sf):
    return _round(spatial.classify(v.points(spark, sf), v.polygons(spark, sf), keep_far=True), "km")


def nearest_k_shelters(spark, sf):
    targets = v.shelters(spark, sf).filter("kind = 'shelter'")
    return _round(spatial.nearest_k(v.points(spark, sf), targets, 5), "km")


def nearest_shelter_within(spark, sf):
    out = spatial.nearest_within(v.points(spark, sf), v.shelters(spark, sf), 5.0)
    return _round(out.select("point_id", "target_id", "km"), "km")


def radius_join(spark, sf):
    return spatial.within_radius_by_place(v.points(spark, sf), v.shelters(spark, sf), 15.0, 6)


def grid_nearest(spark, sf):
    out = spatial.nearest_on_grid(v.points(spark, sf), v.shelters(spark, sf).select("target_id", "lat", "lon"))
    return _round(out.select("point_id", "target_id", "degrees"), "degrees")


def position_join(spark, sf):
    nodes = v.road_nodes(spark, sf)
    out = spatial.join_on_position(v.points(spark, sf).select("point_id", "lat", "lon"), nodes)
    return out.select("point_id", "node_id")


def off_network(spark, sf):
    """Points whose nearest road node is more than 5 km away, in flat degrees times 111."""
    points, nodes = v.points(spark, sf), v.road_nodes(spark, sf).withColumnRenamed("node_id", "target_id")
    best = spatial.nearest_within(points, nodes, 5.0)
    return best.filter("target_id IS NULL").select("point_id")


def compass_to_nearest(spark, sf):
    points, targets = v.points(spark, sf), v.shelters(spark, sf)
    best = spatial.nearest_k(points, targets, 1)
    both = best.join(points, "point_id").join(
        targets.select("target_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), "target_id"
    )
    heading = geo.compass(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    return both.select("point_id", "target_id", heading.alias("heading"))


def representative_points(spark, sf):
    return _round(geo.representative_points(v.polygons(spark, sf)), "lat", "lon")


def polygon_measures(spark, sf):
    out = geo.polygon_measures(v.polygons(spark, sf))
    return out.select(
        "polygon_id", F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"),
        F.round("area_ha", 1).alias("area_ha"), (F.col("area_m2") >= 100).alias("large_enough"),
    )


def layer_bounds(spark, sf):
    return spatial.layer_bounds(v.points(spark, sf))


def grid_keys(spark, sf):
    pts = v.points(spark, sf)
    cell, blk = geo.rain_cell(F.col("lat"), F.col("lon")), geo.block(F.col("lat"), F.col("lon"))
    idx = geo.grid_index(F.col("lat"), F.col("lon"), 28.6, 77.4, 0.001)
    keyed = pts.select(blk[0].alias("block_row"), blk[1].alias("block_col"), cell[0].alias("r"), idx[0].alias("i"))
    return keyed.groupBy("block_row", "block_col").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("r").alias("rain_rows"), F.count_distinct("i").alias("grid_rows")
    )


def district_grid_nodes(spark, sf):
    out = spatial.grid_nodes_in(v.polygons(spark, sf), 0.25)
    return out.select("polygon_id", "lat", "lon")


def contested_layers(spark, sf):
    """How many polygons contain each area's points: a count by class, as a layer health figure."""
    hits = spatial.containing_polygons(v.points(spark, sf), v.polygons(spark, sf))
    classes = v.polygons(spark, sf).select("polygon_id", "hazard_class")
    return hits.join(classes, "polygon_id").groupBy("hazard_class").agg(F.count(F.lit(1)).alias("n_points"))


_KNN = f"""SELECT point_id, target_id, round(km, 6) AS km, rank FROM (SELECT point_id, target_id, km,
  row_number() OVER (PARTITION BY point_id ORDER BY km, target_id) AS rank FROM d) WHERE rank <= 5"""
_D = f"SELECT point_id, target_id, {v.haversine_sql('p.lat', 'p.lon', 's.lat', 's.lon')} AS km FROM pt p, shelter s"
_HEADING = """['N','NE','E','SE','S','SW','W','NW'][(floor((degrees(atan2(
  sin(radians(s.lon-p.lon))*cos(radians(s.lat)),
  cos(radians(p.lat))*sin(radians(s.lat))-sin(radians(p.lat))*cos(radians(s.lat))*cos(radians(s.lon-p.lon))))+382.5e0)/45e0)::BIGINT % 8)+1]"""

QUERIES = {
    "representative_points": (
        representative_points,
        v.sql(
            "side",
            """SELECT polygon_id, round(lat, 6) AS lat, round(arg_max((x + nx)/2, nx - x), 6) AS lon FROM (
            SELECT *, lead(x) OVER w AS nx, row_number() OVER w AS r FROM cut WINDOW w AS (PARTITION BY polygon_id ORDER BY x)) WHERE r % 2 = 1 GROUP BY polygon_id, lat""",
            mid="SELECT polygon_id, (min(y1) + max(y1))/2 AS lat FROM side GROUP BY 1",
            cut="SELECT polygon_id, lat, x1 + (lat-y1)*(x2-x1)/(y2-y1) AS x FROM side JOIN mid USING (polygon_id) WHERE (y1 > lat) <> (y2 > lat)",
        ),
    ),
    "point_in_polygon": (
        point_in_polygon,
        v.sql("pt inside", "SELECT point_id, min(polygon_id) AS polygon_id FROM pt LEFT JOIN inside USING (point_id) GROUP BY 1"),
    ),
    "nearest_polygon": (
        nearest_polygon,
        v.sql("classified", "SELECT point_id, polygon_id, hazard_class, exact, round(km, 6) AS km FROM classified"),
    ),
    "nearest_polygon_any": (
        nearest_polygon_any,
        v.sql(
            "classified outline",
            """SELECT c.point_id, c.polygon_id, c.hazard_class, c.exact, round(coalesce(c.km, o.km), 6) AS km
            FROM classified c JOIN (SELECT point_id, min(km) AS km FROM outline GROUP BY 1) o USING (point_id)""",
        ),
    ),
    "nearest_k_shelters": (nearest_k_shelters, v.sql("pt shelter", _KNN, d=_D + " WHERE kind = 'shelter'")),
    "nearest_shelter_within": (
        nearest_shelter_within,
        v.sql(
            "pt shelter",
            """SELECT point_id, target_id, round(km, 6) AS km FROM pt LEFT JOIN (SELECT point_id, target_id, km FROM (
            SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, target_id) AS r FROM d WHERE km <= 5e0)
            WHERE r = 1) b USING (point_id)""",
            d=_D,
        ),
    ),
    "radius_join": (
        radius_join,
        v.sql("pt shelter", "SELECT point_id, target_id, round(km, 6) AS km FROM d WHERE km <= 15e0", d=_D),
    ),
    "grid_nearest": (
        grid_nearest,
        v.sql(
            "pt shelter",
            """SELECT point_id, target_id, round(degrees, 6) AS degrees FROM pt LEFT JOIN (
            SELECT point_id, target_id, g AS degrees FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY g, target_id) AS r
            FROM d WHERE g <= 0.3e0) WHERE r = 1) b USING (point_id)""",
            d="""SELECT point_id, target_id, sqrt(power((p.lon-s.lon)*cos(radians(p.lat)),2)+power(p.lat-s.lat,2)) AS g
            FROM pt p, shelter s""",
        ),
    ),
    "position_join": (
        position_join,
        v.sql(
            "pt node",
            """SELECT point_id, node_id FROM pt p JOIN node n ON round(p.lat*100000)::BIGINT = round(n.lat*100000)::BIGINT
            AND round(p.lon*100000)::BIGINT = round(n.lon*100000)::BIGINT""",
        ),
    ),
    "off_network": (
        off_network,
        v.sql(
            "pt node",
            f"""SELECT point_id FROM pt p WHERE NOT EXISTS (SELECT 1 FROM node n
            WHERE {v.haversine_sql('p.lat', 'p.lon', 'n.lat', 'n.lon')} <= 5e0)""",
        ),
    ),
    "compass_to_nearest": (
        compass_to_nearest,
        v.sql(
            "pt shelter",
            f"""SELECT b.point_id, b.target_id, {_HEADING} AS heading FROM (SELECT *, row_number() OVER
            (PARTITION BY point_id ORDER BY km, target_id) AS r FROM d) b JOIN pt p USING (point_id)
            JOIN shelter s USING (target_id) WHERE r = 1""",
            d=_D,
        ),
    ),
    "polygon_measures": (
        polygon_measures,
        v.sql(
            "side",
            """SELECT polygon_id, round(sum(sign(d)*role*cx)/(3e0*sum(role*abs(d))), 6) AS centroid_lon,
            round(sum(sign(d)*role*cy)/(3e0*sum(role*abs(d))), 6) AS centroid_lat,
            round(sum(role*abs(m))/20000e0, 1) AS area_ha, true AS large_enough
            FROM (SELECT polygon_id, ring, CASE WHEN ring = 0 THEN 1 ELSE -1 END AS role, sum(x1*y2-x2*y1) AS d,
              sum((x1+x2)*(x1*y2-x2*y1)) AS cx, sum((y1+y2)*(x1*y2-x2*y1)) AS cy, sum(e1*n2-e2*n1) AS m FROM metres GROUP BY 1,2)
            GROUP BY 1""",
            ends="SELECT polygon_id, ring, x1, y1, x2, y2, row_number() OVER () AS i FROM side",
            angles="""SELECT i, w, radians(CASE WHEN w = 1 THEN y1 ELSE y2 END) AS phi, radians((CASE WHEN w = 1 THEN x1 ELSE x2 END) - 81) AS lam FROM ends, (VALUES (1),(2)) AS t(w)""",
            conformal="""SELECT i, w, lam, atanh(sin(phi)) - k*atanh(sin(phi)*k) AS q FROM angles, (SELECT 2e0*sqrt(n)/(1+n) AS k FROM (SELECT 1e0/298.257223563e0/(2e0-1e0/298.257223563e0) AS n))""",
            sphere="SELECT i, w, atan2(sinh(q), cos(lam)) AS xi, atanh(sin(lam)/sqrt(sinh(q)*sinh(q)+1e0)) AS eta FROM conformal",
            flat="""SELECT i, w, 500000e0 + 0.9996e0*r*(eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta)) AS e,
              0.9996e0*r*(xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta)) AS m
              FROM sphere, (SELECT 6378137e0/(1+n)*(1+n*n/4+n*n*n*n/64) AS r, n/2-2*n*n/3+5*n*n*n/16 AS a1, 13*n*n/48-3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3
              FROM (SELECT 1e0/298.257223563e0/(2e0-1e0/298.257223563e0) AS n))""",
            metres="SELECT ends.*, a.e AS e1, a.m AS n1, b.e AS e2, b.m AS n2 FROM ends JOIN flat a ON a.i = ends.i AND a.w = 1 JOIN flat b ON b.i = ends.i AND b.w = 2",
        ),
    ),
    "layer_bounds": (
        layer_bounds,
        v.sql("pt", "SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM pt"),
    ),
    "grid_keys": (
        grid_keys,
        v.sql(
            "pt",
            """SELECT trunc(lat/0.25e0)::BIGINT AS block_row, trunc(lon/0.25e0)::BIGINT AS block_col, count(*) AS n,
            count(DISTINCT round_even(lat/0.1e0, 0)::BIGINT) AS rain_rows,
            count(DISTINCT floor((lat-28.6e0)/0.001e0)::BIGINT) AS grid_rows FROM pt GROUP BY 1,2""",
        ),
    ),
    "district_grid_nodes": (
        district_grid_nodes,
        v.sql(
            "side",
            """SELECT polygon_id, lat, lon FROM g, side WHERE (y1 > lat) <> (y2 > lat)
            AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 GROUP BY 1,2,3 HAVING count(*) % 2 = 1""",
            g="""SELECT r*0.25e0 AS lat, c*0.25e0 AS lon FROM (SELECT unnest(generate_series(100, 140)) AS r)
            CROSS JOIN (SELECT unnest(generate_series(300, 340)) AS c)""",
        ),
    ),
    "contested_layers": (
        contested_layers,
        v.sql("inside poly", "SELECT hazard_class, count(*) AS n_points FROM inside JOIN poly USING (polygon_id) GROUP BY 1"),
    ),
}
