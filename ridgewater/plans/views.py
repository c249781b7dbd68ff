"""Input views that map the test tables onto the library's schemas, in Spark and in DuckDB SQL.

The tables hold no coordinates, so positions come from integer arithmetic that both engines evaluate
alike. ``CTE`` holds the DuckDB text of each view and ``sql`` puts the needed ones in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Hexagon around a nation's centre and the hole cut into every fifth one (dx, dy).
OUTER = [(0.2637, 0.0113), (0.1291, 0.2179), (-0.1373, 0.2231), (-0.2719, -0.0071), (-0.1327, -0.2293), (0.1409, -0.2117)]
HOLE = [(0.0937, 0.0093), (0.0431, 0.0879), (-0.0491, 0.0917), (-0.1019, -0.0037), (-0.0513, -0.0891), (0.0471, -0.0853)]
CLASSES = ["LOW", "MODERATE", "SIGNIFICANT", "EXTREME"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat(key: str, factor: int):
    return F.lit(28.65) + F.expr(f"({key} * {factor}L) % 2850") / F.lit(1000.0)


def _lon(key: str, factor: int):
    return F.lit(77.5) + F.expr(f"({key} * {factor}L) % 3600") / F.lit(1000.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("point_id"),
        _lat("c_custkey", 7919).alias("lat"),
        _lon("c_custkey", 104729).alias("lon"),
        F.col("c_nationkey").alias("area"),
    )


def shelters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("target_id"),
        _lat("s_suppkey", 6151).alias("lat"),
        _lon("s_suppkey", 15485863).alias("lon"),
        F.when(F.col("s_nationkey") % 3 == 0, "hospital").otherwise("shelter").alias("kind"),
        F.col("s_name").alias("name"),
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cx = F.lit(77.8) + F.lit(0.7) * (F.col("n_nationkey") % 5)
    cy = F.lit(28.9) + F.lit(0.5) * F.floor(F.col("n_nationkey") / 5)

    def ring(offsets):
        return F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in offsets])

    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("polygon_id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("region"),
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("n_nationkey") % 4 + 1).alias("hazard_class"),
        F.when(F.col("n_nationkey") % 5 == 0, F.array(ring(OUTER), ring(HOLE)))
        .otherwise(F.array(ring(OUTER)))
        .alias("rings"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with a time-zone-aware time stamp."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rain_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with rain only: point_id, ts, mm."""
    return (
        events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("point_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.round(F.sum("value") / 10.0, 3).alias("mm"))
    )


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour of the record for every point; mm is null where nothing was measured."""
    from ridgewater.operators.rain import densify

    return densify(rain_observed(spark, sf_dir))


def case_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored case per order: case_id, year, district, value, label."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("case_id"),
        F.year("o_orderdate").alias("year"),
        F.to_date("o_orderdate").alias("day"),
        (F.col("c_nationkey") % 13).alias("district"),
        F.col("o_totalprice").alias("value"),
        F.round(F.col("o_totalprice") * 7.0 % 1000.0, 2).alias("value2"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"),
    )


def episode_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .filter(F.col("event_type") == "error")
        .select((F.col("user_id")).alias("district"), F.to_date("ts").alias("day"))
        .distinct()
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain cells: row, col, slope, twi, hsg, cover."""
    cover = F.element_at(
        F.create_map(
            *[
                F.lit(v)
                for pair in {"ECONOMY": 10, "STANDARD": 40, "PROMO": 50, "LARGE": 60, "SMALL": 30, "MEDIUM": 20}.items()
                for v in pair
            ]
        ),
        F.col("p_type"),
    )
    return table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 100").alias("row"),
        (F.col("p_partkey") % 100).alias("col"),
        F.col("p_size").cast("double").alias("slope"),
        (F.lit(3.0) + (F.col("p_partkey") % 150) / F.lit(10.0)).alias("twi"),
        (F.lit(1) + F.col("p_partkey") % 4).cast("int").alias("hsg"),
        cover.alias("cover"),
    )


def road_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road ways before one-way rules: src, dst, length_m, oneway. Nodes are numbered 0..N-1."""
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    flag = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "-1").otherwise("no")
    return (
        lines.join(F.broadcast(n), F.lit(True))
        .select(
            (F.col("l_partkey") % F.col("n")).alias("src"),
            ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % F.col("n")).alias("dst"),
            (F.lit(50.0) + F.col("l_quantity") * 10.0).alias("length_m"),
            flag.alias("oneway"),
        )
        .filter("src <> dst")
    )


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("node_id"), _lat("p_partkey", 7919).alias("lat"), _lon("p_partkey", 104729).alias("lon")
    )


def _hexagons() -> str:
    rows = []
    for ring, offsets in enumerate((OUTER, HOLE)):
        for i, (dx, dy) in enumerate(offsets):
            ex, ey = offsets[(i + 1) % len(offsets)]
            rows.append(f"({ring},{dx}e0,{dy}e0,{ex}e0,{ey}e0)")
    return ",".join(rows)


CTE = {
    "pt": """SELECT c_custkey AS point_id, 28.65e0 + ((c_custkey*7919) % 2850)/1000e0 AS lat,
      77.5e0 + ((c_custkey*104729) % 3600)/1000e0 AS lon, c_nationkey AS area FROM customer""",
    "shelter": """SELECT s_suppkey AS target_id, 28.65e0 + ((s_suppkey*6151) % 2850)/1000e0 AS lat,
      77.5e0 + ((s_suppkey*15485863) % 3600)/1000e0 AS lon,
      CASE WHEN s_nationkey % 3 = 0 THEN 'hospital' ELSE 'shelter' END AS kind, s_name AS name FROM supplier""",
    "poly": """SELECT n_nationkey::BIGINT AS polygon_id, n_name AS name, n_regionkey AS region,
      ['LOW','MODERATE','SIGNIFICANT','EXTREME'][n_nationkey % 4 + 1] AS hazard_class,
      77.8e0 + 0.7e0*(n_nationkey % 5) AS cx, 28.9e0 + 0.5e0*(n_nationkey // 5) AS cy FROM nation""",
    "side": f"""SELECT polygon_id, hazard_class, ring, cx+dx1 AS x1, cy+dy1 AS y1, cx+dx2 AS x2, cy+dy2 AS y2
      FROM poly JOIN (VALUES {_hexagons()}) h(ring,dx1,dy1,dx2,dy2) ON h.ring = 0 OR polygon_id % 5 = 0""",
    "inside": """SELECT point_id, polygon_id FROM pt, side WHERE (y1 > lat) <> (y2 > lat)
      AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 GROUP BY 1,2 HAVING count(*) % 2 = 1""",
    "foot": """SELECT point_id, polygon_id, lat, lon, y1 + t*(y2-y1) AS fy, x1 + t*(x2-x1) AS fx FROM (
      SELECT *, greatest(0e0, least(1e0, ((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t
      FROM pt, side)""",
    "outline": """SELECT point_id, polygon_id, min(12742e0*asin(sqrt(power(sin(radians(fy-lat)/2),2)
      + cos(radians(lat))*cos(radians(fy))*power(sin(radians(fx-lon)/2),2)))) AS km FROM foot GROUP BY 1,2""",
    "classified": """SELECT p.point_id, b.polygon_id, y.hazard_class, coalesce(b.exact, false) AS exact, b.km
      FROM pt p LEFT JOIN (
        SELECT point_id, polygon_id, i_id IS NOT NULL AS exact, CASE WHEN i_id IS NULL THEN km ELSE 0e0 END AS km,
          row_number() OVER (PARTITION BY point_id ORDER BY (i_id IS NULL), CASE WHEN i_id IS NULL THEN km ELSE 0e0 END,
            polygon_id) AS rn
        FROM (SELECT o.*, i.polygon_id AS i_id FROM outline o LEFT JOIN inside i USING (point_id, polygon_id))
        WHERE i_id IS NOT NULL OR km <= 15e0) b ON b.point_id = p.point_id AND b.rn = 1
      LEFT JOIN poly y ON y.polygon_id = b.polygon_id""",
    "rain0": """SELECT user_id AS point_id, date_trunc('hour', ts) AS ts, round(sum(value)/10e0, 3) AS mm
      FROM events GROUP BY 1,2""",
    "rain": """SELECT u.point_id, h.ts, r.mm FROM (SELECT DISTINCT point_id FROM rain0) u
      CROSS JOIN (SELECT unnest(generate_series((SELECT min(ts) FROM rain0), (SELECT max(ts) FROM rain0),
        INTERVAL 1 HOUR)) AS ts) h LEFT JOIN rain0 r ON r.point_id = u.point_id AND r.ts = h.ts""",
    "case_day": """SELECT o_orderkey AS case_id, year(o_orderdate) AS year, o_orderdate::DATE AS day,
      c_nationkey % 13 AS district, o_totalprice AS value, round((o_totalprice*7e0) % 1000e0, 2) AS value2,
      (o_orderpriority = '1-URGENT')::INT AS label FROM orders JOIN customer ON o_custkey = c_custkey""",
    "episode_day": """SELECT DISTINCT user_id AS district, ts::DATE AS day FROM events WHERE event_type = 'error'""",
    "cell": """SELECT p_partkey // 100 AS row, p_partkey % 100 AS col, p_size::DOUBLE AS slope,
      3e0 + (p_partkey % 150)/10e0 AS twi, (1 + p_partkey % 4)::INT AS hsg,
      CASE p_type WHEN 'ECONOMY' THEN 10 WHEN 'STANDARD' THEN 40 WHEN 'PROMO' THEN 50 WHEN 'LARGE' THEN 60
        WHEN 'SMALL' THEN 30 WHEN 'MEDIUM' THEN 20 END AS cover FROM part""",
    "way": """SELECT l_partkey % n AS src, (l_partkey*31 + l_suppkey*17) % n AS dst, 50e0 + l_quantity*10e0 AS length_m,
      CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN '-1' ELSE 'no' END AS oneway
      FROM lineitem, (SELECT count(*) AS n FROM part) WHERE l_partkey % n <> (l_partkey*31 + l_suppkey*17) % n""",
    "node": """SELECT p_partkey AS node_id, 28.65e0 + ((p_partkey*7919) % 2850)/1000e0 AS lat,
      77.5e0 + ((p_partkey*104729) % 3600)/1000e0 AS lon FROM part""",
    "edge": """SELECT src, dst, min(length_m) AS length_m FROM (
      SELECT src, dst, length_m FROM way WHERE oneway <> '-1'
      UNION ALL SELECT dst, src, length_m FROM way WHERE oneway <> 'yes') GROUP BY 1,2""",
}
NEEDS = {
    "side": ["poly"], "inside": ["pt", "side"], "foot": ["pt", "side"], "outline": ["foot"],
    "classified": ["outline", "inside", "poly"], "rain": ["rain0"], "edge": ["way"],
}


def _order(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _order(NEEDS.get(name, []), seen)
            seen.append(name)
    return seen


def sql(views: str, body: str, **extra: str) -> str:
    """``body`` with the named views (space separated) and extra CTEs in front of it."""
    parts = [(n, CTE[n]) for n in _order(views.split(), [])] + list(extra.items())
    if not parts:
        return body
    recursive = "RECURSIVE " if any("USING KEY" in text for _, text in parts) else ""
    texts = []
    for name, text in parts:
        if "USING KEY" in text:  # the text names its own columns and key
            texts.append(text)
        else:
            texts.append(f"{name} AS ({text})")
    return "WITH " + recursive + ",\n".join(texts) + "\n" + body


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"12742e0*asin(sqrt(power(sin(radians({lat2}-{lat1})/2),2)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*power(sin(radians({lon2}-{lon1})/2),2)))"
    )
