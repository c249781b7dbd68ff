"""Threshold and status rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewater.functions.columns import let, lookup

# Base thresholds in mm per hazard class and window, (watch, critical).
CLASS_THRESHOLDS = {
    "EXTREME": {"1h": (4.0, 8.0), "3h": (8.0, 15.0), "24h": (20.0, 40.0)},
    "SIGNIFICANT": {"1h": (12.0, 20.0), "3h": (20.0, 35.0), "24h": (45.0, 80.0)},
    "MODERATE": {"1h": (20.0, 35.0), "3h": (35.0, 55.0), "24h": (70.0, 120.0)},
    "LOW": {"1h": (35.0, 60.0), "3h": (55.0, 90.0), "24h": (110.0, 180.0)},
}
# Orderings and the multiplier of each soil group.
STATUSES = ["SAFE", "WATCH", "CRITICAL"]
CLASS_ORDER = ["LOW", "MODERATE", "SIGNIFICANT", "EXTREME"]
SOIL_MULTIPLIER = {"A": 1.15, "B": 1.0, "C": 0.9, "D": 0.8}
BAND_TO_CLASS = {
    "VERY LOW": "LOW",
    "LOW": "LOW",
    "MODERATE": "MODERATE",
    "HIGH": "SIGNIFICANT",
    "VERY HIGH": "EXTREME",
}


def window_status(rain: Column, watch: Column, critical: Column) -> Column:
    known = rain.isNotNull() & watch.isNotNull() & critical.isNotNull()
    return (
        F.when(~known, F.lit(None).cast("string"))
        .when(rain >= critical, "CRITICAL")
        .when(rain >= watch, "WATCH")
        .otherwise("SAFE")
    )


def status_rank(status: Column) -> Column:
    """0 for no status, then 1, 2, 3."""
    return lookup(status, {s: i for i, s in enumerate(STATUSES, 1)}, 0)


def worst_status(*statuses: Column) -> Column:
    ranks = [status_rank(s) for s in statuses]
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.when(top > 0, F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.when(top > 0, top)))


def antecedent_multiplier(mm: Column) -> Column:
    return F.when(mm >= 100, 0.70).when(mm >= 50, 0.85).otherwise(1.0)


def catchment_multiplier(area_km2: Column) -> Column:
    return F.when(area_km2 >= 1000, 1.0).when(area_km2 >= 100, 0.95).when(area_km2 >= 0, 0.85).otherwise(1.0)


def soil_multiplier(group: Column) -> Column:
    return lookup(group, SOIL_MULTIPLIER, 1.0)


def static_multiplier(group: Column, area_km2: Column) -> Column:
    return F.round(soil_multiplier(group) * catchment_multiplier(area_km2), 3)


def class_thresholds(hazard_class: Column, multiplier: Column | None = None) -> dict[str, tuple[Column, Column]]:
    """{window: (watch, critical)} of a class, scaled and rounded to 0.1 mm; null for no class."""
    multiplier = F.lit(1.0) if multiplier is None else multiplier
    out = {}
    for window in ("1h", "3h", "24h"):
        pair = []
        for i in (0, 1):
            base = lookup(hazard_class, {c: CLASS_THRESHOLDS[c][window][i] for c in CLASS_ORDER})
            pair.append(F.round(base * multiplier, 1))
        out[window] = (pair[0], pair[1])
    return out


def with_thresholds(df: DataFrame, limits: dict[str, tuple[Column, Column]]) -> tuple[DataFrame, dict]:
    """Adds watch_<window> and critical_<window> columns; returns {window: (rain, watch, critical)} over them.

    Later rules mention each threshold many times, so they refer to columns, not to the whole expression.
    """
    df = df.withColumns({f"{k}_{w}": pair[i] for w, pair in limits.items() for i, k in enumerate(("watch", "critical"))})
    return df, {w: (F.col(w), F.col(f"watch_{w}"), F.col(f"critical_{w}")) for w in limits}


def resolve_class(surveyed: Column, band: Column) -> tuple[Column, Column]:
    """(class, source): the surveyed class wins, the index band fills gaps."""
    from_band = lookup(band, BAND_TO_CLASS)
    source = F.when(surveyed.isNotNull(), "atlas").when(band.isNotNull(), "ffpi")
    return F.coalesce(surveyed, from_band), source


def index_band(value: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value < 3.5, "VERY LOW")
        .when(value < 4.5, "LOW")
        .when(value < 5.5, "MODERATE")
        .when(value < 6.5, "HIGH")
        .otherwise("VERY HIGH")
    )


def prefer_exact(exact: Column, gridded: Column) -> Column:
    return F.coalesce(exact, gridded)


def critical_fraction(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Largest rain / critical over the windows, 0 when none is known. ``pairs``: window -> (rain, critical)."""
    shares = [rain / F.when(crit > 0, crit) for rain, crit in pairs.values()]
    return F.coalesce(F.greatest(*shares), F.lit(0.0))


def headroom(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """struct(mm, window) left to critical in the window with the smallest remaining share."""
    options = []
    for i, (window, (rain, crit)) in enumerate(pairs.items()):
        left = F.greatest(crit - rain, F.lit(0.0))
        options.append(
            F.when(
                rain.isNotNull() & crit.isNotNull(),
                F.struct((left / crit).alias("share"), F.lit(i).alias("i"), left.alias("mm"), F.lit(window).alias("window")),
            )
        )
    best = F.least(*options)
    return F.struct(best.mm.alias("mm"), best.window.alias("window"))


def zone_status(pairs: dict[str, tuple[Column, Column, Column]]) -> Column:
    """Worst status over windows; ``pairs``: window -> (rain, watch, critical)."""
    return worst_status(*[window_status(*p) for p in pairs.values()])


def worst_window(pairs: dict[str, tuple[Column, Column, Column]]) -> Column:
    """struct(rank, ratio, neg_pos, window, rain_mm, threshold_mm) of the deciding window, or null.

    Higher status first, then the larger rain / threshold, then the earlier window.
    """
    options = []
    for i, (window, (rain, watch, critical)) in enumerate(pairs.items()):
        status = window_status(rain, watch, critical)
        limit = F.when(status == "CRITICAL", critical).otherwise(watch)
        options.append(
            F.when(
                status.isNotNull(),
                F.struct(
                    status_rank(status).alias("rank"),
                    (rain / limit).alias("ratio"),
                    F.lit(-i).alias("neg_pos"),
                    F.lit(window).alias("window"),
                    rain.alias("rain_mm"),
                    limit.alias("threshold_mm"),
                ),
            )
        )
    return F.greatest(*options)


def outlook(now_rank: Column, forecast: Column, thresholds: dict[str, tuple[Column, Column]]) -> Column:
    """First hour of the worst status the forecast reaches, if worse than now; else null.

    ``forecast`` is an array of struct(1h, 3h, 24h). Result: struct(status, in_hours, window, rain_mm, threshold_mm).
    """
    worst = F.transform(
        forecast, lambda step: worst_window({w: (step[w], watch, crit) for w, (watch, crit) in thresholds.items()})
    )
    return first_worst(now_rank, worst)


def outlook_ahead(worst: Column, now_rank: Column, window, hours: int = 6) -> Column:
    """The same from a series: ``worst`` is each hour's own worst_window, looked up over the next hours.

    Result: struct(rank, neg_hour, window, rain_mm, threshold_mm), null when nothing worse than SAFE is ahead.
    """
    options = []
    for k in range(1, hours + 1):
        x = F.lead(worst, k).over(window)
        found = F.struct(
            x["rank"].alias("rank"), F.lit(-k).alias("neg_hour"), x.window.alias("window"), x.rain_mm.alias("rain_mm"),
            x.threshold_mm.alias("threshold_mm"),
        )
        options.append(F.when((x["rank"] >= 2) & (x["rank"] > now_rank), found))
    return F.greatest(*options)


def first_worst(now_rank: Column, worst: Column) -> Column:
    """Pick from an array of worst_window results, one per hour ahead."""
    hours = F.transform(
        worst,
        lambda x, i: F.struct(
            F.coalesce(x["rank"], F.lit(0)).alias("rank"), (-i - 1).alias("neg_hour"), x.window.alias("window"),
            x.rain_mm.alias("rain_mm"), x.threshold_mm.alias("threshold_mm"),
        ),
    )
    names = F.array(*[F.lit(s) for s in STATUSES])
    return let(
        F.array_max(hours),
        lambda best: F.when(
            (best["rank"] >= 2) & (best["rank"] > now_rank),
            F.struct(
                F.element_at(names, best["rank"]).alias("status"), (-best.neg_hour).alias("in_hours"),
                best.window.alias("window"), best.rain_mm.alias("rain_mm"), best.threshold_mm.alias("threshold_mm"),
            ),
        ),
    )


def rain_tier(current: Column, next_hours: Column) -> Column:
    """HEAVY at 15 mm, MODERATE at 5 mm over the current hour and the next three, else LIGHT.

    Hours are added in order, as a running sum does, so a total on a limit falls on the same side of it.
    """
    total = F.aggregate(F.slice(next_hours, 1, 3), F.coalesce(current, F.lit(0.0)), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(total >= 15, "HEAVY").when(total >= 5, "MODERATE").otherwise("LIGHT")


def flood_risk(ratio: Column, depth: Column, velocity: Column) -> Column:
    """0..1 risk of a road: 40 % coverage, 40 % depth up to 1 m, 20 % velocity up to 2 m/s."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return unit(F.lit(0.40) * unit(ratio) + F.lit(0.40) * unit(depth) + F.lit(0.20) * unit(velocity / 2.0))


# Fixed values: (blocked at or above, risky at or above) of the three rule sets.
ROAD_STATUS_RULES = {"coverage": (0.8, 0.1), "risk": (0.8, 0.2), "half": (0.5, None)}


def road_status(value: Column, rule: str = "risk") -> Column:
    blocked, risky = ROAD_STATUS_RULES[rule]
    out = F.when(value >= blocked, "BLOCKED")
    out = out.when(value >= risky, "RISKY") if risky is not None else out.when(value > 0, "RISKY")
    return out.otherwise("SAFE")


def provider_record(matched: Column, risk: Column, depth: Column, velocity: Column, source: Column, confidence: Column):
    """Flood record of a point: the matched polygon's values with defaults, or a dry record."""
    level = F.when(matched, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(risk, F.lit(0.8))))).otherwise(0.0)
    return F.struct(
        level.alias("risk"),
        F.when(matched, F.coalesce(depth, F.lit(0.5))).otherwise(0.0).alias("depth"),
        F.when(matched, F.coalesce(velocity, F.lit(0.0))).otherwise(0.0).alias("velocity"),
        road_status(level, "risk").alias("status"),
        F.when(matched, F.coalesce(source, F.lit("GeoJSON"))).otherwise("GeoJSON").alias("source"),
        F.when(matched, F.coalesce(confidence, F.lit(1.0))).otherwise(1.0).alias("confidence"),
    )


def zone_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f,%.5f", lat, lon)


def risk_order(status: Column, fraction: Column, hazard_class: Column, probability: Column) -> list[Column]:
    """Most at risk first."""
    rank = lookup(hazard_class, {c: i for i, c in enumerate(CLASS_ORDER)}, 0)
    return [
        F.desc(status_rank(status)),
        F.desc(F.coalesce(fraction, F.lit(0.0))),
        F.desc(rank),
        F.desc(F.coalesce(probability, F.lit(0.0))),
    ]


def critical_message(label: Column, hazard_class: Column, hit: Column) -> Column:
    """Alert text from the worst window: struct(window, rain_mm, threshold_mm)."""
    return F.format_string(
        "%s is CRITICAL now. Rain of the past %s: %.1f mm; limit for hazard class %s: %.0f mm.",
        label,
        hit.window,
        hit.rain_mm,
        hazard_class,
        hit.threshold_mm,
    )


def forecast_message(label: Column, hazard_class: Column, expected: Column) -> Column:
    return F.format_string(
        "%s may turn CRITICAL in %d h. Forecast for %s: %.1f mm; limit for hazard class %s: %.0f mm.",
        label,
        expected.in_hours,
        expected.window,
        expected.rain_mm,
        hazard_class,
        expected.threshold_mm,
    )


def diversified_cards(zones: DataFrame, slots: dict[str, int] | None = None) -> DataFrame:
    """Cards for display: per status the most at-risk zones, at most one per area unless short.

    ``zones``: zone_id, status, area, risk_key (higher is worse). SAFE shows its safest zone. Unfilled
    slots are topped up from the remaining zones, worst first. Columns: zone_id, status, area, risk_key,
    position.
    """
    from ridgewater.operators.scale import top_per_group

    slots = slots or {"CRITICAL": 2, "WATCH": 2, "SAFE": 1}
    total = sum(slots.values())
    known = zones.select("zone_id", "status", "area", F.col("risk_key").cast("double").alias("risk_key"))
    known = known.filter(F.col("status").isin(*slots))
    both = known.withColumn("_k", F.explode(F.array(F.col("risk_key"), -F.col("risk_key")))).withColumn(
        "_way", F.col("_k") == F.col("risk_key")
    )
    # At most `total` cards exist and each can rule out one area, so no list needs more than 2 * total
    # zones: the best of each area first, then the rest by risk. The table below has a fixed size.
    order = [F.desc("_k"), F.col("zone_id")]
    in_area = top_per_group(both, ["status", "_way", "area"], order, total, "_in_area")
    short = top_per_group(
        in_area.withColumn("_first", (F.col("_in_area") == 1).cast("int")),
        ["status", "_way"],
        [F.desc("_first"), *order],
        total * 2,
        "_pick",
    )
    short = short.groupBy("zone_id", "status", "area", "risk_key").agg(F.lit(1).alias("_one"))
    rows = short.drop("_one")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"zone_id {fields['zone_id']}, status string, area {fields['area']}, risk_key double, position long"
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: _pick_cards(pdf, slots), schema)


def _pick_cards(pdf, slots: dict[str, int]):
    """Fill the slots from the short list (at most 2 * 2 * slots zones per status)."""
    ranked = pdf.sort_values(["risk_key", "zone_id"], ascending=[False, True])
    chosen: list = []
    areas: set = set()

    def take(rows, count: int) -> int:
        taken = 0
        for fresh_only in (True, False):
            for zone, area in zip(rows.zone_id, rows.area):
                if taken < count and zone not in chosen and (not fresh_only or area not in areas):
                    chosen.append(zone)
                    areas.add(area)
                    taken += 1
        return taken

    missing = 0
    for status, count in slots.items():
        rows = ranked[ranked.status == status]
        missing += count - take(rows[::-1] if status == "SAFE" else rows, count)
    take(ranked, missing)
    out = ranked[ranked.zone_id.isin(chosen)]
    return out.assign(position=range(1, len(out) + 1))[["zone_id", "status", "area", "risk_key", "position"]]


def register_sql_functions(spark: SparkSession) -> None:
    """SQL-bodied temporary functions for SQL users; they are inlined into plans."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION rw_haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) "
        "RETURNS DOUBLE RETURN 2 * 6371.0D * asin(sqrt(least(1.0D, power(sin(radians(lat2 - lat1) / 2), 2) "
        "+ cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION rw_window_status(rain DOUBLE, watch DOUBLE, critical DOUBLE) "
        "RETURNS STRING RETURN CASE WHEN rain IS NULL OR watch IS NULL OR critical IS NULL THEN NULL "
        "WHEN rain >= critical THEN 'CRITICAL' WHEN rain >= watch THEN 'WATCH' ELSE 'SAFE' END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION rw_index_band(value DOUBLE) RETURNS STRING RETURN CASE "
        "WHEN value IS NULL THEN NULL WHEN value < 3.5 THEN 'VERY LOW' WHEN value < 4.5 THEN 'LOW' "
        "WHEN value < 5.5 THEN 'MODERATE' WHEN value < 6.5 THEN 'HIGH' ELSE 'VERY HIGH' END"
    )
