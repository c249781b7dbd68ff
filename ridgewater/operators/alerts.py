"""Which zones to alert, which limits they go by, and when an alert may be sent again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewater.functions import status as st
from ridgewater.operators.scale import carry_forward, spread_join
from ridgewater.operators.spatial import nearest_on_grid
from ridgewater.session import drop_staged, stage

COOLDOWN_HOURS = 6.0
AHEAD_HOURS = 3
CALIBRATED_DEGREES = 0.3
WINDOWS = ("1h", "3h", "24h")


def zone_limits(zones: DataFrame, calibrated: DataFrame, multiplier: Column | None = None) -> DataFrame:
    """Adds watch_<window>, critical_<window> and threshold_source to every zone.

    The nearest point of the calibrated grid within 0.3 degrees gives its own limits ("calibrated"); zones beyond get
    their class's, scaled by ``multiplier`` ("heuristic"); zones of no class get none. ``zones``: zone_id, lat, lon,
    effective_class and what the multiplier reads; ``calibrated``: target_id, lat, lon, window_name, watch, critical.
    """
    grid = calibrated.groupBy("target_id", "lat", "lon").agg(
        *[F.max(F.when(F.col("window_name") == w, F.col(k))).alias(f"_{k}_{w}") for w in WINDOWS for k in ("watch", "critical")]
    )
    grid = stage(grid, "limit-grid")
    near = nearest_on_grid(zones.withColumnRenamed("zone_id", "point_id"), grid, CALIBRATED_DEGREES).withColumnRenamed("point_id", "zone_id")
    found = spread_join(near, grid.drop("lat", "lon"), ["target_id"], "zone_id", "left")
    of_class = st.class_thresholds(F.col("effective_class"), multiplier)
    fits = F.col("target_id").isNotNull()
    limits = {f"{k}_{w}": F.when(fits, F.col(f"_{k}_{w}")).otherwise(of_class[w][i]) for w in WINDOWS for i, k in enumerate(("watch", "critical"))}
    source = F.when(fits, "calibrated").when(F.col("effective_class").isNotNull(), "heuristic")
    dropped = [f"_{k}_{w}" for w in WINDOWS for k in ("watch", "critical")]
    return found.withColumns({**limits, "threshold_source": source}).drop(*dropped, "target_id", "degrees")


def alert_candidates(
    series: DataFrame, limits: dict[str, tuple[Column, Column, Column]], expected: Column, label: Column, hazard_class: Column, within: int = AHEAD_HOURS
) -> DataFrame:
    """Hours at which a zone is worth an alert: zone_id, ts, kind ("now" or "ahead") and the message.

    ``limits``: window -> (rain, watch, critical). A zone that is CRITICAL now is told so by the window furthest above its
    limit; else one whose outlook ``expected`` turns CRITICAL within three hours is warned ahead.
    """
    hit = st.worst_window(limits)
    rows = series.select("zone_id", "ts", label.alias("_label"), hazard_class.alias("_class"), hit.alias("_hit"), expected.alias("_expected"))
    now = F.col("_hit.rank") == 3
    ahead = (F.col("_expected.status") == "CRITICAL") & (F.col("_expected.in_hours") <= within)
    kind = F.when(now, "now").when(ahead, "ahead")
    text = F.when(kind == "now", st.critical_message(F.col("_label"), F.col("_class"), F.col("_hit"))).otherwise(
        st.forecast_message(F.col("_label"), F.col("_class"), F.col("_expected"))
    )
    return rows.select("zone_id", "ts", kind.alias("kind"), text.alias("message")).filter("kind IS NOT NULL")


def offered(candidates: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Candidates for each subscriber of the zone, from the time of the subscription on. ``subscriptions``: subscriber, zone_id, since."""
    pairs = spread_join(subscriptions, candidates, ["zone_id"], "subscriber")
    return pairs.filter(F.col("ts") >= F.col("since")).drop("since")


def alerts_to_send(candidates: DataFrame, subscriptions: DataFrame, hours: float = COOLDOWN_HOURS) -> DataFrame:
    """subscriber, zone_id, ts, kind, message of the alerts that go out: one cooldown for both kinds of alert.

    Of several candidates of a zone at one time "now" goes before "ahead". Only keys and times take part in the cooldown.
    """
    once = stage(candidates.groupBy("zone_id", "ts").agg(F.max(F.struct("kind", "message")).alias("a")).select("zone_id", "ts", "a.*"), "candidates")
    sent = cooldown(offered(once.select("zone_id", "ts"), subscriptions), ["subscriber", "zone_id"], hours)
    return spread_join(sent, once, ["zone_id", "ts"], "subscriber")


def cooldown(alerts: DataFrame, keys: list[str], hours: float = COOLDOWN_HOURS) -> DataFrame:
    """Alerts that are sent: the first per key, then each at least ``hours`` after the last one sent. Columns: keys, ts.

    Every alert is linked to the first one at or after its own time plus the gap, by an as-of look-up over time ranges.
    The alerts sent are those that the links reach from a key's first: they are found by doubling, so a key with n alerts
    sent takes log2(n) rounds, and no key is held in one row or one task. Times are exact to the microsecond.
    """
    gap = int(hours * 3_600_000_000)
    times = stage(alerts.select(*keys, F.unix_micros("ts").alias("_t")).filter("_t IS NOT NULL").distinct(), "alert-times")
    # Backwards in time: the last alert met before a probe is the first one at or after it.
    rows = times.select(*keys, "_t", (-F.col("_t")).alias("_back"), F.lit(0).alias("_probe"), F.col("_t").alias("_next"))
    probes = times.select(*keys, "_t", (-F.col("_t") - gap).alias("_back"), F.lit(1).alias("_probe"), F.lit(None).cast("long").alias("_next"))
    met = carry_forward(rows.unionByName(probes), keys, ["_back", "_probe"], ["_next"])
    links = stage(met.filter("_probe = 1").select(*keys, "_t", F.col("last__next").alias("_to")).filter("_to IS NOT NULL"), "alert-links")
    sent = stage(times.groupBy(*keys).agg(F.min("_t").alias("_t")), "alerts-sent")
    while True:
        reached = stage(sent.join(links, [*keys, "_t"]).select(*keys, F.col("_to").alias("_t")), "alerts-reached")
        if reached.isEmpty():
            return sent.select(*keys, F.timestamp_micros("_t").alias("ts"))
        old, sent = sent, stage(sent.unionByName(reached), "alerts-sent")
        second = links.select(*keys, F.col("_t").alias("_to"), F.col("_to").alias("_further"))
        longer = stage(links.join(second, [*keys, "_to"]).select(*keys, "_t", F.col("_further").alias("_to")), "alert-links")
        for table in (old, reached, links):
            drop_staged(table)
        links = longer
