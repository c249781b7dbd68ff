"""Registered queries on rain series, thresholds and status."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgewater.functions import status as st
from ridgewater.operators import rain as rn
from ridgewater.operators import spatial
from ridgewater.plans import views as v
from ridgewater.session import stage

_KEY = ["point_id"]


def trailing_totals(spark, sf):
    hourly = v.rain(spark, sf)
    return hourly.select(
        "point_id",
        "ts",
        F.round(rn.running_total(3, _KEY), 6).alias("running_3h"),
        rn.full_total(24, _KEY, 6).alias("full_24h"),
        rn.present_total(3, _KEY, 6).alias("present_3h"),
    )


def antecedent_variants(spark, sf):
    hourly = v.rain(spark, sf)
    return hourly.select(
        "point_id", "ts", rn.antecedent_to_now(_KEY, 6).alias("to_now"),
        rn.antecedent_before_day(_KEY, 6).alias("before_day"),
    )


def forecast_outlook(spark, sf):
    """Worst status the next six hours reach, per point and hour, where it is worse than now."""
    totals = v.rain(spark, sf).select(
        "point_id", "ts", *[rn.full_total(h, _KEY, 6).alias(w) for w, h in rn.FLOOD_WINDOWS.items()]
    )
    limits = st.CLASS_THRESHOLDS["EXTREME"]
    worst = st.worst_window({w: (F.col(w), F.lit(a), F.lit(b)) for w, (a, b) in limits.items()})
    by_time = Window.partitionBy("point_id").orderBy("ts")
    out = totals.withColumn("worst", worst).withColumn(
        "best", st.outlook_ahead(F.col("worst"), F.coalesce(F.col("worst.rank"), F.lit(0)), by_time)
    )
    names = F.array(*[F.lit(s) for s in st.STATUSES])
    return out.filter("best IS NOT NULL").select(
        "point_id", "ts", F.element_at(names, F.col("best.rank")).alias("status"), (-F.col("best.neg_hour")).alias("in_hours"),
        "best.window", F.round("best.rain_mm", 6).alias("rain_mm"), "best.threshold_mm",
    )


def daily_maxima(spark, sf):
    out = rn.daily_maxima(v.rain(spark, sf), _KEY, 3)
    return out.select("point_id", "day", F.round("peak_mm", 6).alias("peak_mm"))


def _district_rain(spark, sf):
    hourly = v.rain(spark, sf)
    return hourly.select(
        (F.col("point_id") % 13).alias("district"), "point_id", F.year("ts").alias("year"), "ts", "mm"
    )


def district_days(spark, sf):
    out = rn.district_days(_district_rain(spark, sf))
    return out.select(
        "district", "year", "day", *[F.round(w, 6).alias(f"w{w}") for w in rn.FLOOD_WINDOWS],
        F.round("antecedent_5d", 6).alias("antecedent_5d"),
    )


def wettest_driest(spark, sf):
    latest = rn.readings(v.rain(spark, sf), _KEY, 6)
    return latest.filter(F.col("24h").isNotNull()).groupBy("ts").agg(
        F.max(F.struct("24h", "point_id")).alias("hi"), F.min(F.struct("24h", "point_id")).alias("lo")
    ).select("ts", F.col("hi.point_id").alias("wettest"), F.round(F.col("hi.24h"), 6).alias("wettest_mm"),
             F.col("lo.point_id").alias("driest"), F.round(F.col("lo.24h"), 6).alias("driest_mm"))


def live_payload(spark, sf):
    """Readings rebuilt from feed text: each point's series is written as a payload and parsed back."""
    hourly = v.rain(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    payload = hourly.groupBy("point_id").agg(
        F.sort_array(F.collect_list(F.struct(stamp.alias("t"), "mm"))).alias("h")  # one record's hours
    )
    text = F.to_json(
        F.struct(
            F.lit(30.0).alias("latitude"),
            F.lit(79.0).alias("longitude"),
            F.struct(F.lit("2024-01-20T13:30").alias("time"), F.lit(0.0).alias("precipitation")).alias("current"),
            F.struct(
                F.transform("h", lambda x: x.t).alias("time"), F.transform("h", lambda x: x.mm).alias("precipitation")
            ).alias("hourly"),
        )
    )
    parsed = rn.parse_payload(payload.select("point_id", text.alias("payload")))
    out = rn.readings_now(parsed, ["point_id"], 6)
    return out.select(
        "point_id", *[F.round(w, 6).alias(f"w{w}") for w in ("1h", "3h", "24h", "72h", "168h")],
        F.size("forecast").alias("n_ahead"), F.round(F.element_at("forecast", 6)["3h"], 6).alias("w3h_in_6"),
    )


def zone_table(spark, sf):
    """Zones with hazard class, soil group, catchment area and the rain series they read."""
    pts = v.points(spark, sf)
    classes = spatial.classify(pts, v.polygons(spark, sf))
    users = v.rain_observed(spark, sf).select("point_id").distinct().agg(F.count(F.lit(1)).alias("u"))
    part = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("point_id"), F.col("p_size").alias("_size")
    )
    return (
        pts.join(classes, "point_id")
        .join(part, "point_id", "left")
        .join(F.broadcast(users), F.lit(True))  # one row
        .select(
            F.col("point_id").alias("zone_id"),
            "lat",
            "lon",
            "area",
            "hazard_class",
            "exact",
            "km",
            (F.col("point_id") % F.col("u")).alias("rain_id"),
            F.element_at(F.array(*[F.lit(g) for g in "ABCD"]), (F.col("point_id") % 4 + 1).cast("int")).alias("soil"),
            (F.col("_size") * 40.0).alias("up_area_km2"),
            st.index_band(F.lit(3.0) + (F.col("point_id") % 50) / F.lit(10.0)).alias("band"),
        )
    )


def zone_readings(spark, sf):
    """The reading of every series at the last hour of the record; hours without rain need no rows."""
    observed = v.rain_observed(spark, sf)
    span = observed.agg(F.min("ts").alias("first"), F.max("ts").alias("now"))
    return rn.reading_at(observed, span, _KEY, 6).withColumnRenamed("point_id", "rain_id")


def zone_status(spark, sf):
    """Every zone that is WATCH or CRITICAL at the end of the record, with the reason, worst first."""
    # The static facts of a zone change rarely: they are written once, and the final sort, which reads its
    # input twice, starts from the table.
    zones = stage(zone_table(spark, sf), "zone-static")
    effective, source = st.resolve_class(F.col("hazard_class"), F.col("band"))
    zones = zones.withColumn("effective_class", effective).withColumn("hazard_source", source)
    zones = zones.filter(F.col("effective_class").isNotNull())
    z = zones.join(zone_readings(spark, sf), "rain_id")
    multiplier = st.antecedent_multiplier(F.col("antecedent_48h")) * st.static_multiplier(F.col("soil"), F.col("up_area_km2"))
    z, triples = st.with_thresholds(z, st.class_thresholds(F.col("effective_class"), multiplier))
    fraction = st.critical_fraction({w: (r, c) for w, (r, _, c) in triples.items()})
    left = st.headroom({w: (r, c) for w, (r, _, c) in triples.items()})
    out = z.select(
        "zone_id",
        "effective_class",
        "hazard_source",
        st.zone_status(triples).alias("status"),
        *[F.round(r, 3).alias(f"rain_{w}") for w, (r, _, _) in triples.items()],
        triples["24h"][2].alias("critical_24h"),
        F.round(fraction, 6).alias("critical_fraction"),
        F.round(left.mm, 6).alias("headroom_mm"),
        left.window.alias("headroom_window"),
    )
    out = out.filter(F.col("status").isin("WATCH", "CRITICAL"))
    return out.orderBy(*st.risk_order(F.col("status"), F.col("critical_fraction"), F.col("effective_class"), F.lit(None)))


def alert_banner(spark, sf):
    """Zone ids per status, flood and landslide kept apart, as one text list per status."""
    z = zone_table(spark, sf).join(zone_readings(spark, sf), "rain_id")
    z, triples = st.with_thresholds(z, st.class_thresholds(F.col("hazard_class")))
    flood = st.zone_status(triples)
    slide_limits = {"24h": (20.0, 40.0), "72h": (45.0, 80.0), "168h": (90.0, 150.0)}
    slide = st.zone_status({w: (F.col(w), F.lit(a), F.lit(b)) for w, (a, b) in slide_limits.items()})
    layers = F.explode(F.create_map(F.lit("flood"), flood, F.lit("landslide"), slide))
    out = z.select("zone_id", layers.alias("layer", "status")).filter(F.col("status").isin("WATCH", "CRITICAL"))
    return out.groupBy("layer", "status").agg(
        F.count(F.lit(1)).alias("n_zones"), F.min("zone_id").alias("first_zone"), F.max("zone_id").alias("last_zone")
    )


def diversified_cards(spark, sf):
    zones = zone_status_all(spark, sf)
    return st.diversified_cards(zones)


def zone_status_all(spark, sf):
    z = zone_table(spark, sf).join(zone_readings(spark, sf), "rain_id")
    effective, _ = st.resolve_class(F.col("hazard_class"), F.col("band"))
    z, triples = st.with_thresholds(z, st.class_thresholds(effective))
    status = st.zone_status(triples)
    fraction = st.critical_fraction({w: (r, c) for w, (r, _, c) in triples.items()})
    key = st.status_rank(status) * 1000.0 + F.round(fraction, 6)
    return z.select("zone_id", status.alias("status"), "area", key.alias("risk_key"))


def rain_tiers(spark, sf):
    full = rn.forecasts(v.rain(spark, sf), _KEY, decimals=6)
    tier = st.rain_tier(F.col("mm"), F.transform("forecast", lambda x: x["1h"]))
    return full.withColumn("tier", tier).groupBy("point_id", "tier").agg(F.count(F.lit(1)).alias("n_hours"))


def rain_cells_shared(spark, sf):
    """Zones read the series of their 0.1 degree cell: zones and mean reading per cell."""
    from ridgewater.functions import geo

    z = zone_table(spark, sf)
    row, col = geo.rain_cell(F.col("lat"), F.col("lon"))
    keyed = z.withColumn("cell_row", row).withColumn("cell_col", col)
    cell = keyed.groupBy("cell_row", "cell_col").agg(F.min("zone_id").alias("first_zone"), F.count(F.lit(1)).alias("n"))
    first = z.select(F.col("zone_id").alias("first_zone"), "rain_id")
    return cell.join(first, "first_zone").join(zone_readings(spark, sf).select("rain_id", "24h"), "rain_id").select(
        "cell_row", "cell_col", "first_zone", "n", F.round("24h", 6).alias("w24h")
    )


def latest_reading(spark, sf):
    """As-of: each series' latest observed hour not after noon of the 15th."""
    observed = v.rain_observed(spark, sf)
    return rn.latest_at(observed, _KEY, F.lit("2024-01-15 12:40:00").cast("timestamp"))


def _total(hours: int, end: int = 0) -> str:
    return f"OVER (PARTITION BY point_id ORDER BY ts ROWS BETWEEN {hours - 1 - end} PRECEDING AND " + (
        "CURRENT ROW)" if end == 0 else f"{-end} PRECEDING)"
    )


def _full(hours: int) -> str:
    w = _total(hours)
    return f"CASE WHEN count(*) {w} = {hours} THEN round(sum(coalesce(mm, 0e0)) {w}, 6) END"


_READ = ", ".join(f'{_full(h)} AS "{w}"' for w, h in rn.READING_WINDOWS.items())
_ZONE = """SELECT p.point_id AS zone_id, c.hazard_class, p.lat, p.lon, p.area, p.point_id % u AS rain_id,
  ['A','B','C','D'][p.point_id % 4 + 1] AS soil, a.p_size * 40e0 AS up_area_km2,
  3e0 + (p.point_id % 50)/10e0 AS idx
  FROM pt p JOIN classified c USING (point_id) LEFT JOIN part a ON a.p_partkey = p.point_id
  CROSS JOIN (SELECT count(DISTINCT user_id) AS u FROM events)"""
_BAND = "CASE WHEN idx < 3.5e0 THEN 'LOW' WHEN idx < 4.5e0 THEN 'LOW' WHEN idx < 5.5e0 THEN 'MODERATE' WHEN idx < 6.5e0 THEN 'SIGNIFICANT' ELSE 'EXTREME' END"
_LIM = "(VALUES " + ",".join(
    f"('{c}',{','.join(f'{a}e0,{b}e0' for a, b in t.values())})" for c, t in st.CLASS_THRESHOLDS.items()
) + ") t(cls,w1,c1,w3,c3,w24,c24)"
_NOW = "SELECT point_id AS rain_id, * EXCLUDE (point_id) FROM reading WHERE ts = (SELECT max(ts) FROM reading)"


def _worst(r1: str, r3: str, r24: str, lim: tuple = ("w1", "c1", "w3", "c3", "w24", "c24")) -> str:
    pairs = [(r1, lim[0], lim[1]), (r3, lim[2], lim[3]), (r24, lim[4], lim[5])]
    crit = " OR ".join(f"{r} >= {c}" for r, _, c in pairs)
    watch = " OR ".join(f"{r} >= {w}" for r, w, _ in pairs)
    known = " OR ".join(f"({r} IS NOT NULL AND {w} IS NOT NULL)" for r, w, _ in pairs)
    return f"CASE WHEN {crit} THEN 'CRITICAL' WHEN {watch} THEN 'WATCH' WHEN {known} THEN 'SAFE' END"


_LEAD = ", ".join(
    f'lead("{w}", {k}) OVER (PARTITION BY point_id ORDER BY ts) AS a{w}_{k}' for k in range(1, 7) for w in ("1h", "3h", "24h")
)


def _rank(r: str, w: float, c: float) -> str:
    return f"CASE WHEN {r} >= {c} THEN 3 WHEN {r} >= {w} THEN 2 WHEN {r} IS NOT NULL THEN 1 END"


_EXT = st.CLASS_THRESHOLDS["EXTREME"]
_STEPS = " UNION ALL ".join(
    f"""SELECT point_id, ts, {k} AS in_hours, {i} AS pos, '{w}' AS win, a{w}_{k} AS rain_mm,
    {_rank(f'a{w}_{k}', *_EXT[w])} AS rk, CASE WHEN a{w}_{k} >= {_EXT[w][1]} THEN {_EXT[w][1]}e0 ELSE {_EXT[w][0]}e0 END AS lim, now_rk FROM ahead"""
    for k in range(1, 7)
    for i, w in enumerate(("1h", "3h", "24h"))
)
_NOW_RANK = "coalesce(greatest(" + ", ".join(_rank('"' + w + '"', *_EXT[w]) for w in _EXT) + "), 0)"

QUERIES = {
    "zone_status": (
        zone_status,
        v.sql(
            "rain pt classified",
            f"""SELECT zone_id, cls AS effective_class, hazard_source, status, round("1h",3) AS rain_1h,
            round("3h",3) AS rain_3h, round("24h",3) AS rain_24h, c24 AS critical_24h,
            round(greatest("1h"/c1, "3h"/c3, "24h"/c24), 6) AS critical_fraction,
            round(h.mm, 6) AS headroom_mm, h.win AS headroom_window
            FROM (SELECT *, {_worst('"1h"', '"3h"', '"24h"')} AS status,
              list_min([{{'s': greatest(c1-"1h",0)/c1, 'i': 0, 'mm': greatest(c1-"1h",0), 'win': '1h'}},
                {{'s': greatest(c3-"3h",0)/c3, 'i': 1, 'mm': greatest(c3-"3h",0), 'win': '3h'}},
                {{'s': greatest(c24-"24h",0)/c24, 'i': 2, 'mm': greatest(c24-"24h",0), 'win': '24h'}}]) AS h FROM scaled)
            WHERE status IN ('WATCH','CRITICAL')""",
            reading=f"SELECT point_id, ts, {_READ} FROM rain",
            zone=_ZONE,
            scaled=f"""SELECT zone_id, cls, CASE WHEN hazard_class IS NULL THEN 'ffpi' ELSE 'atlas' END AS hazard_source,
            "1h", "3h", "24h", {', '.join(f'round({c}*m, 1) AS {c}' for c in ('w1', 'c1', 'w3', 'c3', 'w24', 'c24'))}
            FROM (SELECT z.*, r.*, t.*, (CASE WHEN antecedent_48h >= 100 THEN 0.7e0 WHEN antecedent_48h >= 50 THEN 0.85e0 ELSE 1e0 END)
              * round((CASE soil WHEN 'A' THEN 1.15e0 WHEN 'B' THEN 1e0 WHEN 'C' THEN 0.9e0 ELSE 0.8e0 END)
              * (CASE WHEN up_area_km2 >= 1000 THEN 1e0 WHEN up_area_km2 >= 100 THEN 0.95e0 WHEN up_area_km2 >= 0 THEN 0.85e0 ELSE 1e0 END), 3) AS m
              FROM zone z JOIN ({_NOW}) r USING (rain_id) JOIN {_LIM} ON t.cls = coalesce(hazard_class, {_BAND}))""",
        ),
    ),
    "trailing_totals": (
        trailing_totals,
        v.sql(
            "rain",
            f"""SELECT point_id, ts, round(sum(coalesce(mm,0e0)) {_total(3)}, 6) AS running_3h, {_full(24)} AS full_24h,
            round(sum(mm) {_total(3)}, 6) AS present_3h FROM rain""",
        ),
    ),
    "antecedent_variants": (
        antecedent_variants,
        v.sql(
            "rain",
            f"""SELECT point_id, ts, {_full(48)} AS to_now, CASE WHEN row_number() OVER (PARTITION BY point_id ORDER BY ts) <= 24
            THEN round(first_value(mm) OVER (PARTITION BY point_id ORDER BY ts), 6)
            ELSE round(sum(mm) OVER (PARTITION BY point_id ORDER BY ts ROWS BETWEEN 71 PRECEDING AND 24 PRECEDING), 6) END AS before_day
            FROM rain""",
        ),
    ),
    "forecast_outlook": (
        forecast_outlook,
        v.sql(
            "rain",
            """SELECT point_id, ts, ['SAFE','WATCH','CRITICAL'][rk] AS status, in_hours, win AS "window",
            round(rain_mm, 6) AS rain_mm, lim AS threshold_mm FROM (SELECT *, row_number() OVER (PARTITION BY point_id, ts
              ORDER BY rk DESC, in_hours, rain_mm/lim DESC, pos) AS r FROM step WHERE rk IS NOT NULL)
            WHERE r = 1 AND rk >= 2 AND rk > now_rk""",
            reading=f'SELECT point_id, ts, {_full(1)} AS "1h", {_full(3)} AS "3h", {_full(24)} AS "24h" FROM rain',
            ahead=f"SELECT point_id, ts, {_NOW_RANK} AS now_rk, {_LEAD} FROM reading",
            step=_STEPS,
        ),
    ),
    "daily_maxima": (
        daily_maxima,
        v.sql(
            "rain",
            f"""SELECT point_id, ts::DATE AS day, round(max(t), 6) AS peak_mm FROM (SELECT point_id, ts,
            sum(coalesce(mm,0e0)) {_total(3)} AS t FROM rain) GROUP BY 1,2 HAVING count(*) = 24""",
        ),
    ),
    "district_days": (
        district_days,
        v.sql(
            "rain",
            """SELECT p.point_id % 13 AS district, year(p.day) AS year, p.day, round(max(w1),6) AS w1h, round(max(w3),6) AS w3h,
            round(max(w24),6) AS w24h, round(avg(coalesce(a.mm, 0e0)),6) AS antecedent_5d
            FROM peak p LEFT JOIN ante a USING (point_id, day) GROUP BY 1,2,3""",
            run=f"""SELECT point_id, ts, coalesce(mm,0e0) AS w1, sum(coalesce(mm,0e0)) {_total(3)} AS w3,
            sum(coalesce(mm,0e0)) {_total(24)} AS w24 FROM rain""",
            peak="""SELECT point_id, day, max(w1) AS w1, max(w3) AS w3, max(w24) AS w24 FROM (
            SELECT *, ts::DATE AS day FROM run UNION ALL SELECT *, ts::DATE + 1 AS day FROM run) GROUP BY 1,2 HAVING count(*) = 48""",
            ante="""SELECT point_id, d + k AS day, sum(mm) AS mm FROM (SELECT point_id, ts::DATE AS d, sum(mm) AS mm FROM rain GROUP BY 1,2)
            CROSS JOIN (SELECT unnest([2,3,4,5,6]) AS k) GROUP BY 1,2""",
        ),
    ),
    "wettest_driest": (
        wettest_driest,
        v.sql(
            "rain",
            """SELECT DISTINCT ts, first_value(point_id) OVER hi AS wettest, round(first_value(t) OVER hi, 6) AS wettest_mm,
            first_value(point_id) OVER lo AS driest, round(first_value(t) OVER lo, 6) AS driest_mm FROM r WHERE t IS NOT NULL
            WINDOW hi AS (PARTITION BY ts ORDER BY t DESC, point_id DESC), lo AS (PARTITION BY ts ORDER BY t, point_id)""",
            r=f"SELECT point_id, ts, {_full(24)} AS t FROM rain",
        ),
    ),
    "live_payload": (
        live_payload,
        v.sql(
            "rain",
            """SELECT point_id, "1h" AS w1h, "3h" AS w3h, "24h" AS w24h, "72h" AS w72h, "168h" AS w168h, 6::INT AS n_ahead, w3h_in_6
            FROM (SELECT *, lead("3h", 6) OVER (PARTITION BY point_id ORDER BY ts) AS w3h_in_6 FROM reading)
            WHERE ts = TIMESTAMP '2024-01-20 13:00:00'""",
            reading=f"SELECT point_id, ts, {_READ} FROM rain",
        ),
    ),
    "alert_banner": (
        alert_banner,
        v.sql(
            "rain pt classified",
            f"""SELECT layer, status, count(*) AS n_zones, min(zone_id) AS first_zone, max(zone_id) AS last_zone FROM (
            SELECT zone_id, 'flood' AS layer, {_worst('"1h"', '"3h"', '"24h"')} AS status FROM z
            UNION ALL SELECT zone_id, 'landslide', {_worst('"24h"', '"72h"', '"168h"', ('20', '40', '45', '80', '90', '150'))} FROM z)
            WHERE status IN ('WATCH','CRITICAL') GROUP BY 1,2""",
            reading=f"SELECT point_id, ts, {_READ} FROM rain",
            zone=_ZONE,
            z=f"SELECT * FROM zone JOIN ({_NOW}) r USING (rain_id) LEFT JOIN {_LIM} ON t.cls = hazard_class",
        ),
    ),
    "diversified_cards": (diversified_cards, None),
    "rain_tiers": (
        rain_tiers,
        v.sql(
            "rain",
            """SELECT point_id, CASE WHEN t >= 15 THEN 'HEAVY' WHEN t >= 5 THEN 'MODERATE' ELSE 'LIGHT' END AS tier, count(*) AS n_hours
            FROM (SELECT point_id, coalesce(sum(mm) OVER (PARTITION BY point_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 0) AS t FROM rain)
            GROUP BY 1,2""",
        ),
    ),
    "rain_cells_shared": (
        rain_cells_shared,
        v.sql(
            "rain pt classified",
            f"""SELECT cell_row, cell_col, first_zone, n, r."24h" AS w24h FROM (
            SELECT round_even(lat/0.1e0, 0)::BIGINT AS cell_row, round_even(lon/0.1e0, 0)::BIGINT AS cell_col, min(zone_id) AS first_zone,
            count(*) AS n FROM zone GROUP BY 1,2) c JOIN zone z ON z.zone_id = c.first_zone JOIN ({_NOW}) r USING (rain_id)""",
            reading=f"SELECT point_id, ts, {_READ} FROM rain",
            zone=_ZONE,
        ),
    ),
    "latest_reading": (
        latest_reading,
        v.sql(
            "rain0",
            """SELECT point_id, max(ts) AS ts, arg_max(mm, ts) AS mm FROM rain0
            WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1""",
        ),
    ),
}
