"""Registered queries on cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgewater.functions import status as st
from ridgewater.operators import raster as ra
from ridgewater.plans import views as v


def _terrain(spark, sf):
    """Cells with a height made from the part table."""
    return v.table(spark, sf, "part").select(
        F.expr("p_partkey div 100").alias("row"), (F.col("p_partkey") % 100).alias("col"),
        (F.col("p_size") * 12.0 + (F.col("p_partkey") * 37) % 101).alias("z"),
        (F.col("p_size") % 3).alias("kind"),
    )


def _indexed(spark, sf):
    return v.cells(spark, sf).withColumn("ffpi", ra.potential_index(F.col("slope"), F.col("twi"), F.col("hsg"), F.col("cover")))


def ffpi_index(spark, sf):
    return _indexed(spark, sf).select("row", "col", F.round("ffpi", 6).alias("ffpi"))


def ffpi_bands(spark, sf):
    out = _indexed(spark, sf).withColumn("band", st.index_band(F.col("ffpi")))
    return out.groupBy("band").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("ffpi"), 6).alias("mean"), F.round(F.median("ffpi"), 6).alias("median"))


def lookup_codes(spark, sf):
    out = _indexed(spark, sf).withColumn("code", ra.encode(F.col("ffpi")))
    return out.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(ra.decode(F.col("code")) - F.col("ffpi"))), 6).alias("max_error")
    )


def soil_groups(spark, sf):
    part = v.table(spark, sf, "part").select((F.col("p_partkey") % 83).cast("double").alias("sand"), (F.col("p_size") * 1.1).alias("clay"))
    return part.groupBy(ra.soil_group(F.col("sand"), F.col("clay")).alias("hsg")).agg(F.count(F.lit(1)).alias("n"))


def grid_sample(spark, sf):
    """Index value at every point from a grid of 0.03 degree cells; points outside the grid get null."""
    out = ra.sample(v.points(spark, sf), _indexed(spark, sf), 28.65, 77.5, 0.0357, ["ffpi"])
    exact = F.when(F.col("point_id") % 11 == 0, 5.0)
    return out.select("point_id", F.round("ffpi", 6).alias("gridded"), F.round(st.prefer_exact(exact, F.col("ffpi")), 6).alias("ffpi"))


def regrid_mode(spark, sf):
    out = ra.coarsen(_indexed(spark, sf).select("row", "col", "slope", "cover"), 5, {"slope": "mean", "cover": "majority"})
    return out.select("row", "col", "n_cells", F.round("slope", 6).alias("slope"), F.col("cover").cast("int").alias("cover"))


def bilinear_sample(spark, sf):
    pts = v.points(spark, sf).select("point_id", ((F.col("lat") - 28.65) * 6.6).alias("y"), ((F.col("lon") - 77.5) * 27.0).alias("x"))
    return ra.bilinear(pts, _terrain(spark, sf), "z").select("point_id", F.round("z", 6).alias("z"))


def mosaic(spark, sf):
    tiles = v.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("row"), (F.col("l_partkey") % 50).alias("col"), F.col("l_orderkey").alias("tile_order"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("value"), "l_linenumber",
    )
    tiles = tiles.groupBy("row", "col", "tile_order").agg(F.max("value").alias("value"))
    return ra.mosaic(tiles, "value")


def slope_curvature(spark, sf):
    out = ra.slope_curvature(_terrain(spark, sf), "z", 90.0)
    return out.select("row", "col", *[F.round(c, 6).alias(c) for c in ("slope_deg", "curvature", "ruggedness")])


def focal_mean(spark, sf):
    out = ra.focal_mean(_terrain(spark, sf), "z", 5, tile=16)
    return out.select("row", "col", F.round("focal_mean", 6).alias("focal_mean"), F.round("deviation", 6).alias("deviation"))


def focal_mean_wide(spark, sf):
    out = ra.focal_mean(_terrain(spark, sf), "z", 25, tile=64)
    return out.select("row", "col", F.round("focal_mean", 6).alias("focal_mean"), F.round("deviation", 6).alias("deviation"))


def elevation_percentile(spark, sf):
    out = ra.elevation_percentile(_terrain(spark, sf), "z", 12)
    return out.select("row", "col", F.round("percentile", 6).alias("percentile"))


def flow_pointers(spark, sf):
    return ra.flow_pointers(_terrain(spark, sf), "z")


def flow_accumulation(spark, sf):
    return ra.flow_accumulation(_terrain(spark, sf), "z")


def wetness(spark, sf):
    cells = ra.slope_curvature(_terrain(spark, sf), "z", 90.0)
    acc = ra.flow_accumulation(_terrain(spark, sf), "z")
    twi, spi = ra.wetness(F.col("cells") * 90.0, F.col("slope_deg"))
    return cells.join(acc, ["row", "col"]).select("row", "col", F.round(twi, 6).alias("twi"), F.round(spi, 4).alias("spi"))


def drainage(spark, sf):
    out = ra.drainage(_terrain(spark, sf), "z", 8, 90.0)
    return out.select("row", "col", F.round("stream_m", 4).alias("stream_m"), "above_m")


def pixel_sieve(spark, sf):
    out = ra.sieve(_terrain(spark, sf), "kind", 8)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("group").alias("n_groups"), F.max("size").alias("largest"))


def pixel_merge(spark, sf):
    return ra.merge_small(_terrain(spark, sf), "kind", 8)


def _pixels(spark, sf):
    return v.table(spark, sf, "part").select(
        ((F.col("p_partkey") * 7) % 256).cast("double").alias("r"), ((F.col("p_partkey") * 13) % 256).cast("double").alias("g"),
        ((F.col("p_partkey") * 29) % 256).cast("double").alias("b"),
    )


def colour_classes(spark, sf):
    cls = ra.hazard_from_colour(F.col("r"), F.col("g"), F.col("b"))
    near = ra.near_colour(F.col("r"), F.col("g"), F.col("b"), {"VERY_LOW": (250, 230, 170), "LOW": (250, 210, 120)})
    return _pixels(spark, sf).groupBy(cls.alias("hazard"), near.alias("near")).agg(F.count(F.lit(1)).alias("n"))


def colour_histogram(spark, sf):
    return ra.colour_histogram(_pixels(spark, sf), 30)


_ISLOPE = "CASE " + " ".join(f"WHEN slope < {b} THEN {i}e0" for b, i in ra.SLOPE_BREAKS) + " END"
_ITWI = "CASE " + " ".join(f"WHEN twi < {b} THEN {i}e0" for b, i in ra.TWI_BREAKS) + " END"
_IHSG = "CASE hsg " + " ".join(f"WHEN {k} THEN {x}e0" for k, x in ra.SOIL_INDEX.items()) + " END"
_ICOV = "CASE cover " + " ".join(f"WHEN {k} THEN {x}e0" for k, x in ra.COVER_INDEX.items()) + " END"
_IDX = f"""SELECT row, col, slope, cover, CASE WHEN w >= 3 THEN t/w END AS ffpi FROM (SELECT row, col, slope, cover,
  coalesce(s*2e0,0)+coalesce(c,0)+coalesce(h,0)+coalesce(l,0) AS t,
  (CASE WHEN s IS NULL THEN 0 ELSE 2 END)+(c IS NOT NULL)::INT+(h IS NOT NULL)::INT+(l IS NOT NULL)::INT AS w
  FROM (SELECT row, col, slope, cover, {_ISLOPE} AS s, {_ITWI} AS c, {_IHSG} AS h, {_ICOV} AS l FROM cell))"""
_BANDS = "CASE WHEN ffpi IS NULL THEN NULL WHEN ffpi < 3.5 THEN 'VERY LOW' WHEN ffpi < 4.5 THEN 'LOW' WHEN ffpi < 5.5 THEN 'MODERATE' WHEN ffpi < 6.5 THEN 'HIGH' ELSE 'VERY HIGH' END"
_TER = "SELECT p_partkey // 100 AS row, p_partkey % 100 AS col, p_size*12e0 + (p_partkey*37) % 101 AS z, p_size % 3 AS kind FROM part"
_SLOPE = """SELECT row, col, degrees(atan(sqrt(dx*dx+dy*dy))) AS slope_deg, curvature, ruggedness FROM (
  SELECT a.row, a.col, sum(b.z*CASE WHEN b.row=a.row THEN 2 ELSE 1 END*(b.col-a.col))/720e0 AS dx,
  sum(b.z*CASE WHEN b.col=a.col THEN 2 ELSE 1 END*(b.row-a.row))/720e0 AS dy,
  sum(CASE WHEN abs(b.row-a.row)+abs(b.col-a.col) = 1 THEN b.z - a.z ELSE 0 END)/8100e0 AS curvature,
  sqrt(sum((b.z-a.z)*(b.z-a.z))) AS ruggedness, count(*) AS n
  FROM t a JOIN t b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 GROUP BY 1,2) WHERE n = 9"""
_PTR = """SELECT row, col, to_row, to_col FROM (SELECT a.row, a.col, b.row AS to_row, b.col AS to_col,
  row_number() OVER (PARTITION BY a.row, a.col ORDER BY (a.z-b.z)/sqrt(power(b.row-a.row,2)+power(b.col-a.col,2)) DESC, b.row, b.col) AS r
  FROM t a JOIN t b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND b.z < a.z) WHERE r = 1"""
_ACC = """SELECT row, col, count(*) AS cells FROM walk GROUP BY 1,2"""
_WALK = """walk(row, col, s_row, s_col) AS (SELECT row, col, row, col FROM t UNION ALL
  SELECT p.to_row, p.to_col, s_row, s_col FROM walk w JOIN ptr p ON p.row = w.row AND p.col = w.col)"""


def _walk(body: str) -> str:
    return f"WITH RECURSIVE t AS ({_TER}), ptr AS ({_PTR}), {_WALK} {body}"


_HSV = """SELECT r, g, b, mx, CASE WHEN mx = 0 THEN 0 ELSE (mx-mn)/mx END AS s, CASE WHEN mx = mn THEN 0e0 WHEN mx = b THEN 60e0*(r-g)/(mx-mn)+240
  WHEN mx = g THEN 60e0*(b-r)/(mx-mn)+120 ELSE ((60e0*(g-b)/(mx-mn)) % 360 + 360) % 360 END AS h FROM (
  SELECT *, greatest(r,g,b) AS mx, least(r,g,b) AS mn FROM px)"""
_PX = "SELECT ((p_partkey*7)%256)::DOUBLE AS r, ((p_partkey*13)%256)::DOUBLE AS g, ((p_partkey*29)%256)::DOUBLE AS b FROM part"

QUERIES = {
    "ffpi_index": (ffpi_index, v.sql("cell", "SELECT row, col, round(ffpi, 6) AS ffpi FROM idx", idx=_IDX)),
    "ffpi_bands": (
        ffpi_bands,
        v.sql(
            "cell",
            f"SELECT {_BANDS} AS band, count(*) AS n_cells, round(avg(ffpi), 6) AS mean, round(median(ffpi), 6) AS median FROM idx GROUP BY 1",
            idx=_IDX,
        ),
    ),
    "lookup_codes": (
        lookup_codes,
        v.sql(
            "cell",
            """SELECT code, count(*) AS n, round(max(abs(code/25e0 - ffpi)), 6) AS max_error FROM (
            SELECT ffpi, CASE WHEN ffpi IS NULL THEN 255 ELSE greatest(0, least(250, round_even(ffpi*25e0, 0)))::INT END AS code FROM idx) GROUP BY 1""",
            idx=_IDX,
        ),
    ),
    "soil_groups": (
        soil_groups,
        """SELECT CASE WHEN clay >= 40 THEN 'D' WHEN clay >= 27 OR (clay >= 20 AND sand < 45) THEN 'C' WHEN sand >= 50 AND clay < 20 THEN 'A' ELSE 'B' END AS hsg,
        count(*) AS n FROM (SELECT (p_partkey % 83)::DOUBLE AS sand, p_size*1.1e0 AS clay FROM part) GROUP BY 1""",
    ),
    "grid_sample": (
        grid_sample,
        v.sql(
            "cell pt",
            """SELECT point_id, round(ffpi, 6) AS gridded, round(CASE WHEN point_id % 11 = 0 THEN 5e0 ELSE ffpi END, 6) AS ffpi FROM pt
            LEFT JOIN idx ON idx.row = floor((lat-28.65e0)/0.0357e0) AND idx.col = floor((lon-77.5e0)/0.0357e0)""",
            idx=_IDX,
        ),
    ),
    "regrid_mode": (
        regrid_mode,
        v.sql(
            "cell",
            """SELECT a.row, a.col, n_cells, round(slope, 6) AS slope, cover FROM (SELECT row//5 AS row, col//5 AS col, count(*) AS n_cells, avg(slope) AS slope FROM cell GROUP BY 1,2) a
            LEFT JOIN (SELECT row, col, cover FROM (SELECT row//5 AS row, col//5 AS col, cover, row_number() OVER (PARTITION BY row//5, col//5 ORDER BY count(*) DESC, cover) AS r
            FROM cell WHERE cover IS NOT NULL GROUP BY 1,2,3) WHERE r = 1) b ON a.row = b.row AND a.col = b.col""",
        ),
    ),
    "bilinear_sample": (
        bilinear_sample,
        v.sql(
            "pt",
            """SELECT point_id, round(sum(z*w)/nullif(sum(CASE WHEN z IS NOT NULL THEN w END), 0), 6) AS z FROM (
            SELECT point_id, t.z, abs(1-dr-(y-floor(y)))*abs(1-dc-(x-floor(x))) AS w FROM (SELECT point_id, (lat-28.65e0)*6.6e0 AS y, (lon-77.5e0)*27e0 AS x FROM pt),
            (VALUES (0,0),(0,1),(1,0),(1,1)) o(dr,dc) LEFT JOIN t ON t.row = floor(y)+dr AND t.col = floor(x)+dc) GROUP BY 1""",
            t=_TER,
        ),
    ),
    "mosaic": (
        mosaic,
        """SELECT row, col, arg_max(value, tile_order) AS value FROM (SELECT l_suppkey % 10 AS row, l_partkey % 50 AS col, l_orderkey AS tile_order,
        max(l_quantity) FILTER (l_quantity > 10) AS value FROM lineitem GROUP BY 1,2,3) WHERE value IS NOT NULL GROUP BY 1,2""",
    ),
    "slope_curvature": (
        slope_curvature,
        v.sql("", "SELECT row, col, round(slope_deg,6) AS slope_deg, round(curvature,6) AS curvature, round(ruggedness,6) AS ruggedness FROM sl", t=_TER, sl=_SLOPE),
    ),
    "focal_mean": (
        focal_mean,
        v.sql(
            "",
            """SELECT a.row, a.col, round(avg(b.z), 6) AS focal_mean, round(min(a.z) - avg(b.z), 6) AS deviation
            FROM t a JOIN t b ON b.row BETWEEN a.row-5 AND a.row+5 AND b.col BETWEEN a.col-5 AND a.col+5 GROUP BY 1,2""",
            t=_TER,
        ),
    ),
    "focal_mean_wide": (
        focal_mean_wide,
        v.sql(
            "",
            """SELECT a.row, a.col, round(avg(b.z), 6) AS focal_mean, round(min(a.z) - avg(b.z), 6) AS deviation
            FROM t a JOIN t b ON b.row BETWEEN a.row-25 AND a.row+25 AND b.col BETWEEN a.col-25 AND a.col+25 GROUP BY 1,2""",
            t=_TER,
        ),
    ),
    "elevation_percentile": (
        elevation_percentile,
        v.sql(
            "",
            """SELECT a.row, a.col, round(avg((b.z < a.z)::INT)*100e0, 6) AS percentile
            FROM t a JOIN t b ON b.row BETWEEN a.row-12 AND a.row+12 AND b.col BETWEEN a.col-12 AND a.col+12 GROUP BY 1,2""",
            t=_TER,
        ),
    ),
    "flow_pointers": (flow_pointers, v.sql("", "SELECT * FROM ptr", t=_TER, ptr=_PTR)),
    "flow_accumulation": (flow_accumulation, _walk(_ACC)),
    "wetness": (
        wetness,
        f"""WITH RECURSIVE t AS ({_TER}), ptr AS ({_PTR}), {_WALK}, acc AS ({_ACC}), sl AS ({_SLOPE})
    SELECT row, col, round(ln(cells*90e0/tn), 6) AS twi, round(cells*90e0*tn, 4) AS spi FROM (
    SELECT row, col, cells, tan(radians(greatest(slope_deg, 0.1e0))) AS tn FROM sl JOIN acc USING (row, col))""",
    ),
    "drainage": (
        drainage,
        f"""WITH RECURSIVE t AS ({_TER}), ptr AS ({_PTR}), {_WALK}, acc AS ({_ACC}),
        down(s_row, s_col, row, col, d) AS (SELECT row, col, row, col, 0e0 FROM t UNION ALL
          SELECT s_row, s_col, p.to_row, p.to_col, d + 90e0*sqrt(power(p.to_row-p.row,2)+power(p.to_col-p.col,2))
          FROM down w JOIN ptr p ON p.row = w.row AND p.col = w.col JOIN acc a ON a.row = w.row AND a.col = w.col AND a.cells < 8)
        SELECT t.row, t.col, round(e.d, 4) AS stream_m, t.z - z.z AS above_m FROM t LEFT JOIN (
          SELECT w.* FROM down w JOIN acc a ON a.row = w.row AND a.col = w.col WHERE a.cells >= 8) e ON e.s_row = t.row AND e.s_col = t.col
        LEFT JOIN t z ON z.row = e.row AND z.col = e.col""",
    ),
    "pixel_sieve": (
        pixel_sieve,
        v.sql(
            "",
            """SELECT kind, count(*) AS n_cells, count(DISTINCT c) AS n_groups, max(size) AS largest FROM (
            SELECT t.kind, cc.c, count(*) OVER (PARTITION BY cc.c) AS size FROM t JOIN cc ON cc.node = t.row*1000+t.col) WHERE size >= 8 GROUP BY 1""",
            t=_TER,
            link="""SELECT a.row*1000+a.col AS a, b.row*1000+b.col AS b FROM t a JOIN t b ON b.row BETWEEN a.row-1 AND a.row+1
            AND b.col BETWEEN a.col-1 AND a.col+1 AND a.kind = b.kind""",
            cc="""cc(node, c) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM link GROUP BY 1 UNION
            SELECT l.b, min(f.c) FROM cc f JOIN link l ON l.a = f.node JOIN recurring.cc p ON p.node = l.b WHERE f.c < p.c GROUP BY 1)""",
        ),
    ),
    "pixel_merge": (
        pixel_merge,
        v.sql(
            "",
            """SELECT g.row, g.col, coalesce(f.kind, g.kind) AS kind FROM g LEFT JOIN (SELECT w.s, z.kind FROM walk w
            JOIN (SELECT DISTINCT c, kind, size FROM g) z ON z.c = w.reach WHERE w.reach <> w.s AND z.size >= 8) f ON f.s = g.c""",
            t=_TER,
            link="""SELECT a.row*1000+a.col AS a, b.row*1000+b.col AS b FROM t a JOIN t b ON b.row BETWEEN a.row-1 AND a.row+1
            AND b.col BETWEEN a.col-1 AND a.col+1 AND a.kind = b.kind""",
            cc="""cc(node, c) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM link GROUP BY 1 UNION
            SELECT l.b, min(f.c) FROM cc f JOIN link l ON l.a = f.node JOIN recurring.cc p ON p.node = l.b WHERE f.c < p.c GROUP BY 1)""",
            g="""SELECT t.row, t.col, t.kind, cc.c, count(*) OVER (PARTITION BY cc.c) AS size FROM t JOIN cc ON cc.node = t.row*1000+t.col""",
            big="""SELECT s, arg_max(c, size*10000000 - c) AS c FROM (SELECT DISTINCT a.c AS s, b.c, b.size FROM g a JOIN g b ON a.size < 8
            AND b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND a.c <> b.c) GROUP BY s""",
            walk="""walk(s, reach) USING KEY (s, reach) AS (SELECT s, s FROM big UNION SELECT w.s, n.c FROM walk w JOIN big n ON n.s = w.reach)""",
        ),
    ),
    "colour_classes": (
        colour_classes,
        f"""WITH px AS ({_PX}), hsv AS ({_HSV}) SELECT CASE WHEN r > 150 AND g < 120 AND b < 120 AND r > g*1.5e0 AND r > b*1.5e0 AND (h < 15 OR h > 345) AND s > 0.4e0 THEN 'EXTREME'
        WHEN r > 170 AND g >= 70 AND g < 190 AND b < 100 AND r > g*1.15e0 AND r > b*2 AND h >= 10 AND h < 40 AND s > 0.4e0 THEN 'SIGNIFICANT'
        WHEN r > 180 AND g > 170 AND b < 130 AND r > b*1.5e0 AND g > b*1.4e0 AND h >= 40 AND h <= 75 AND s > 0.3e0 THEN 'MODERATE'
        WHEN g > r*1.15e0 AND g > b*1.15e0 AND g > 100 AND s > 0.2e0 AND h >= 70 AND h <= 160 THEN 'LOW' END AS hazard,
        CASE WHEN sqrt(power(r-250,2)+power(g-230,2)+power(b-170,2)) < 35 THEN 'VERY_LOW' WHEN sqrt(power(r-250,2)+power(g-210,2)+power(b-120,2)) < 35 THEN 'LOW' END AS near,
        count(*) AS n FROM hsv GROUP BY 1,2""",
    ),
    "colour_histogram": (
        colour_histogram,
        f"""SELECT (floor(r/10)*10)::INT AS r, (floor(g/10)*10)::INT AS g, (floor(b/10)*10)::INT AS b, count(*) AS n FROM ({_PX}) GROUP BY 1,2,3
        ORDER BY n DESC, 1, 2, 3 LIMIT 30""",
    ),
}
