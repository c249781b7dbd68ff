"""Registered queries on lists, layers, bands and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgewater.functions import geo
from ridgewater.functions import status as st
from ridgewater.operators import listing, quality, rain, raster, reports, spatial
from ridgewater.plans import views as v
from ridgewater.plans.feed_plans import _warnings
from ridgewater.session import new_table_path
from ridgewater.sources import geojson as gj
from ridgewater.sources import tables as tb


def zones_in_order(spark, sf):
    return listing.zones_list(v.shelters(spark, sf), "target_id").select("position", "target_id", "kind", "name")


def reports_newest_first(spark, sf):
    own = v.events(spark, sf).filter("event_type = 'click'").select(F.col("event_id").alias("report_id"), "ts")
    return listing.reports_list(own, "report_id")


def warnings_in_order(spark, sf):
    out = listing.warnings_list(_warnings(spark, sf), reports.SEVERITY)
    return out.select("position", "identifier", "severity_rank", "expires")


def zone_index(spark, sf):
    kind = F.when(F.col("c_custkey") % 7 == 0, "town").otherwise("locality")
    zones = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("zone_id"), kind.alias("kind"), F.col("c_name").alias("label"))
    return listing.zone_index(zones, "zone_id").select("position", "zone_id", "is_town", "label")


def covering_polygons(spark, sf):
    """Points within polygons, outlines included: the polygons' own corners count."""
    corners = v.polygons(spark, sf).select(F.col("polygon_id"), F.posexplode(F.get("rings", F.lit(0))).alias("i", "p"))
    corners = corners.select((F.lit(1_000_000_000) + F.col("polygon_id") * 100 + F.col("i")).alias("point_id"), F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))
    points = v.points(spark, sf).select("point_id", "lat", "lon").unionByName(corners)
    hits = spatial.covers(points, v.polygons(spark, sf))
    own = F.expr("(point_id - 1000000000) div 100 = polygon_id")
    return hits.filter((F.col("point_id") < 1_000_000_000) | own)


def hazardous_road_list(spark, sf):
    edges = v.road_ways(spark, sf).select("src", "dst", "length_m").distinct()
    coded = edges.withColumn("hazard_code", ((F.col("src") + F.col("dst")) % 5).cast("int"))
    return gj.hazardous_roads(coded, v.road_nodes(spark, sf)).select("src", "dst", "length_m", "hazard_code", "x1", "y1", "x2", "y2")


def cleaned_bands(spark, sf):
    raw = v.table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 10 == 0, -9999.0).when(F.col("p_size") % 10 == 1, -3.4e38).when(F.col("p_size") % 10 == 2, float("nan"))
        .otherwise(F.col("p_size").cast("double")).alias("value"),
    )
    return raw.select("p_partkey", raster.clean_band(F.col("value"), -9999.0).alias("value"))


def large_polygons(spark, sf):
    """Polygons and a sliver of each; only those of 100 m2 and more stay."""
    whole = v.polygons(spark, sf).select("polygon_id", "rings")
    p = F.get(F.get("rings", F.lit(0)), F.lit(0))
    sliver = F.array(F.array(*[F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")) for dx, dy in ((0.0, 0.0), (5e-5, 0.0), (0.0, 5e-5))]))
    tiny = whole.select((F.col("polygon_id") + 1000).alias("polygon_id"), sliver.alias("rings"))
    return quality.keep_large(whole.unionByName(tiny)).select("polygon_id", F.size("rings").alias("n_rings"))


def sql_functions(spark, sf):
    st.register_sql_functions(spark)
    v.points(spark, sf).withColumn("key", st.zone_key(F.col("lat"), F.col("lon"))).createOrReplaceTempView("rw_points")
    return spark.sql(
        "SELECT point_id, key, round(rw_haversine_km(lat, lon, 30.0D, 79.0D), 6) AS km, "
        "rw_window_status(point_id % 17, 5.0D, 12.0D) AS status, rw_index_band((point_id % 90) / 10.0D) AS band FROM rw_points"
    )


def shelter_clusters(spark, sf):
    return spatial.distance_clusters(v.shelters(spark, sf).select(F.col("target_id").alias("point_id"), "lat", "lon"), 0.2)


def edge_midpoints(spark, sf):
    n = v.road_nodes(spark, sf)
    a = n.select(F.col("node_id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = n.select(F.col("node_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    edges = v.road_ways(spark, sf).select("src", "dst").distinct().join(a, "src").join(b, "dst")
    lat, lon = geo.midpoint(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return edges.select("src", "dst", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def full_history_days(spark, sf):
    days = v.case_days(spark, sf).filter(rain.has_full_history(F.col("day")))
    return days.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def layers_read_back(spark, sf):
    """Shelter and soil layers written in their file forms and read by their readers."""
    shelters = v.shelters(spark, sf).select(F.col("target_id").cast("string").alias("id"), "name", "kind", F.lit(None).cast("string").alias("amenity"), "lat", "lon")
    path = new_table_path(spark, "shelters")
    shelters.write.json(path)
    read = tb.read_shelters(spark, path, lines=True)
    group = F.when(F.col("p_partkey") % 5 > 0, F.element_at(F.array(*[F.lit(g) for g in "ABCD"]), (F.col("p_partkey") % 4 + 1).cast("int")))
    soil = F.struct(F.col("p_size").cast("double").alias("sand"), F.lit(20.0).alias("clay"), F.lit(30.0).alias("silt"), group.alias("hydrologic_soil_group"))
    path = new_table_path(spark, "soil")
    v.table(spark, sf, "part").select(F.lit(30.0).alias("lat"), F.lit(79.0).alias("lon"), soil.alias("soil")).write.json(path)
    by_kind = read.groupBy(F.col("kind"), "is_evacuation_target").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 4).alias("total"))
    by_group = tb.read_soil(spark, path, lines=True).groupBy(F.col("hsg").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sand_pct"), 4).alias("total"))
    return by_kind.unionByName(by_group.withColumn("is_evacuation_target", F.lit(None).cast("boolean")))


QUERIES = {
    "zones_in_order": (
        zones_in_order,
        v.sql("shelter", "SELECT row_number() OVER (ORDER BY kind DESC, name, target_id) - 1 AS position, target_id, kind, name FROM shelter"),
    ),
    "reports_newest_first": (
        reports_newest_first,
        "SELECT event_id AS report_id, ts, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS position FROM events WHERE event_type = 'click'",
    ),
    "warnings_in_order": (
        warnings_in_order,
        """SELECT row_number() OVER (ORDER BY severity_rank, expires, identifier) - 1 AS position, identifier, severity_rank, expires FROM (
        SELECT 'id-' || doc_id AS identifier, (doc_id % 5)::INT AS severity_rank, ['2024-01-01T00:00:00','','soon','2030-01-01T00:00:00'][doc_id % 4 + 1] AS expires FROM documents)""",
    ),
    "zone_index": (
        zone_index,
        """SELECT row_number() OVER (ORDER BY is_town DESC, label, zone_id) - 1 AS position, zone_id, is_town, label FROM (
        SELECT c_custkey AS zone_id, c_custkey % 7 = 0 AS is_town, c_name AS label FROM customer)""",
    ),
    "covering_polygons": (
        covering_polygons,
        v.sql(
            "inside",
            """SELECT point_id, polygon_id FROM inside
            UNION ALL SELECT 1000000000 + polygon_id * 100 + i, polygon_id FROM poly, (SELECT unnest(range(6)) AS i)""",
        ),
    ),
    "hazardous_road_list": (
        hazardous_road_list,
        v.sql(
            "way node",
            """SELECT DISTINCT src, dst, length_m, ((src + dst) % 5)::INT AS hazard_code, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2
            FROM way JOIN node a ON a.node_id = src JOIN node b ON b.node_id = dst WHERE (src + dst) % 5 >= 2""",
        ),
    ),
    "cleaned_bands": (
        cleaned_bands,
        "SELECT p_partkey, CASE WHEN p_size % 10 > 2 THEN p_size::DOUBLE END AS value FROM part",
    ),
    "large_polygons": (
        large_polygons,
        "SELECT n_nationkey::BIGINT AS polygon_id, (CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END)::INT AS n_rings FROM nation",
    ),
    "sql_functions": (
        sql_functions,
        v.sql(
            "pt",
            f"""SELECT point_id, format('{{:.5f}},{{:.5f}}', lat, lon) AS key, round({v.haversine_sql("lat", "lon", "30e0", "79e0")}, 6) AS km,
            CASE WHEN point_id % 17 >= 12 THEN 'CRITICAL' WHEN point_id % 17 >= 5 THEN 'WATCH' ELSE 'SAFE' END AS status,
            CASE WHEN point_id % 90 < 35 THEN 'VERY LOW' WHEN point_id % 90 < 45 THEN 'LOW' WHEN point_id % 90 < 55 THEN 'MODERATE'
              WHEN point_id % 90 < 65 THEN 'HIGH' ELSE 'VERY HIGH' END AS band FROM pt""",
        ),
    ),
    "shelter_clusters": (
        shelter_clusters,
        v.sql(
            "shelter",
            "SELECT point_id, min(root) AS cluster FROM reach GROUP BY 1",
            reach="""reach(point_id, root) USING KEY (point_id) AS (SELECT target_id, target_id FROM shelter
            UNION SELECT b.target_id, min(r.root) FROM reach r JOIN shelter a ON a.target_id = r.point_id
            JOIN shelter b ON sqrt(power(a.lat-b.lat,2)+power(a.lon-b.lon,2)) <= 0.2e0
            JOIN recurring.reach s ON s.point_id = b.target_id WHERE r.root < s.root GROUP BY b.target_id)""",
        ),
    ),
    "edge_midpoints": (
        edge_midpoints,
        v.sql(
            "way node",
            """SELECT DISTINCT src, dst, round((a.lat+b.lat)/2e0, 6) AS lat, round((a.lon+b.lon)/2e0, 6) AS lon
            FROM way JOIN node a ON a.node_id = src JOIN node b ON b.node_id = dst""",
        ),
    ),
    "full_history_days": (
        full_history_days,
        v.sql("case_day", "SELECT year, count(*) AS n, min(day) AS first, max(day) AS last FROM case_day WHERE strftime(day, '%m-%d') BETWEEN '06-04' AND '09-30' GROUP BY 1"),
    ),
    "layers_read_back": (
        layers_read_back,
        v.sql("shelter", """SELECT kind, kind = 'shelter' AS is_evacuation_target, count(*) AS n, round(sum(lat), 4) AS total FROM shelter GROUP BY 1,2
        UNION ALL SELECT ['A','B','C','D'][p_partkey % 4 + 1], NULL, count(*), round(sum(p_size::DOUBLE), 4) FROM part WHERE p_partkey % 5 > 0 GROUP BY 1"""),
    ),
}
