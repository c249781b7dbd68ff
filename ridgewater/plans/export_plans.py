"""Registered queries on messages, exports and prototype weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgewater.functions import status as st
from ridgewater.functions import text as tx
from ridgewater.operators import calibrate as cal
from ridgewater.operators import rain as rn
from ridgewater.operators import roads
from ridgewater.operators import verify as ver
from ridgewater.plans import views as v
from ridgewater.session import new_table_path
from ridgewater.sources import tables as tb


def alert_messages(spark, sf):
    """Alert text of every wet hour, from its deciding window."""
    wet = v.rain_observed(spark, sf).filter("mm >= 8")
    hit = F.struct(F.lit("1h").alias("window"), F.col("mm").alias("rain_mm"), F.lit(8.0).alias("threshold_mm"))
    label = F.concat(F.lit("zone "), F.col("point_id"))
    text = st.critical_message(label, F.lit("EXTREME"), hit)
    return wet.select("point_id", "ts", text.alias("message"))


def threshold_sink(spark, sf):
    """Point thresholds written as JSON with their scores and read back."""
    hourly = v.rain(spark, sf).withColumn("year", F.year("ts"))
    rarity = {"watch": {w: 0.90 for w in rn.FLOOD_WINDOWS}, "critical": {w: 0.99 for w in rn.FLOOD_WINDOWS}}
    limits = cal.point_thresholds(hourly, rn.FLOOD_WINDOWS, rarity)
    scores = ver.confusion(v.case_days(spark, sf).withColumn("flag", F.col("value") >= 300000.0), "flag", "label")
    path = new_table_path(spark, "thresholds")
    tb.write_thresholds(limits, scores, path)
    back = tb.read_thresholds(spark, path)
    return back.select("point_id", "window_name", F.round("watch", 6).alias("watch"), F.round("critical", 6).alias("critical"))


def poi_mapping(spark, sf):
    """Suppliers as tagged places: kind, default names, and places of other kinds dropped."""
    s = v.shelters(spark, sf)
    amenity = F.element_at(F.array(*[F.lit(a) for a in ("shelter", "community_centre", "social_facility", "hospital", "school")]), (F.col("target_id") % 5 + 1).cast("int"))
    tags = F.create_map(F.lit("amenity"), amenity, F.lit("name"), F.when(F.col("target_id") % 3 == 0, " ").otherwise(F.col("name")))
    out = tb.places_of_interest(s.select(F.col("target_id").alias("id"), tags.alias("tags"), "lat", "lon"))
    return out.select("target_id", "name", "kind", "amenity")


def locality_labels(spark, sf):
    c = v.table(spark, sf, "customer")
    town = F.concat(F.lit("town "), F.col("c_nationkey"))
    district = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("d"), F.col("c_nationkey") % 5))
    label = tx.locality_label(town, (F.col("c_custkey") % 60).cast("double"), district, "the state")
    return c.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def status_weights(spark, sf):
    """Prototype edge weights by status, by risk and by travel time."""
    li = v.table(spark, sf, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "RISKY").when(F.col("l_returnflag") == "R", "UNKNOWN").otherwise("SAFE")
    length, risk = F.col("l_quantity"), F.col("l_discount")
    return li.groupBy("l_returnflag").agg(
        *[F.round(F.sum(roads.status_weight(length, status, risk, rule, length / 30.0)), 4).alias(rule) for rule in ("status", "risk", "time")]
    )


QUERIES = {
    "alert_messages": (
        alert_messages,
        v.sql("rain0", "SELECT point_id, ts, format('zone {} is CRITICAL now. Rain of the past 1h: {:.1f} mm; limit for hazard class EXTREME: 8 mm.', point_id, round(mm, 1)) AS message FROM rain0 WHERE mm >= 8"),
    ),
    "threshold_sink": (
        threshold_sink,
        v.sql(
            "rain",
            """SELECT point_id, w AS window_name, round(quantile_cont(t, 0.9), 6) AS watch, round(quantile_cont(t, 0.99), 6) AS critical FROM (
            SELECT point_id, '1h' AS w, coalesce(mm,0e0) AS t FROM rain
            UNION ALL SELECT point_id, '3h', sum(coalesce(mm,0e0)) OVER (PARTITION BY point_id, year(ts) ORDER BY ts ROWS 2 PRECEDING) FROM rain
            UNION ALL SELECT point_id, '24h', sum(coalesce(mm,0e0)) OVER (PARTITION BY point_id, year(ts) ORDER BY ts ROWS 23 PRECEDING) FROM rain) GROUP BY 1,2""",
        ),
    ),
    "poi_mapping": (
        poi_mapping,
        """SELECT 'osm-' || s_suppkey AS target_id, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 5 = 3 THEN 'Unnamed Hospital' ELSE 'Unnamed Shelter' END ELSE s_name END AS name,
        CASE WHEN s_suppkey % 5 = 3 THEN 'hospital' ELSE 'shelter' END AS kind, ['shelter','community_centre','social_facility','hospital'][s_suppkey % 5 + 1] AS amenity
        FROM supplier WHERE s_suppkey % 5 <> 4""",
    ),
    "locality_labels": (
        locality_labels,
        """SELECT CASE WHEN c_custkey % 60 <= 25 THEN 'town ' || c_nationkey WHEN c_custkey % 3 > 0 THEN 'd' || (c_nationkey % 5) || ' district' ELSE 'the state' END AS label, count(*) AS n
        FROM customer GROUP BY 1""",
    ),
    "status_weights": (
        status_weights,
        """SELECT l_returnflag, round(sum(l_quantity*CASE l_returnflag WHEN 'A' THEN 10 WHEN 'R' THEN 2 ELSE 1 END), 4) AS status,
        round(sum(l_quantity*(l_discount*10e0+1)*CASE l_returnflag WHEN 'R' THEN 1.5e0 ELSE 1 END), 4) AS risk,
        round(sum(l_quantity/30e0*(l_discount*10e0+1)), 4) AS "time" FROM lineitem GROUP BY 1""",
    ),
}
