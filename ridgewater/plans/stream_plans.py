"""Registered queries that run as streams over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgewater.functions import status as st
from ridgewater.operators import reports as rp
from ridgewater.plans import views as v
from ridgewater.plans.feed_plans import _report_events
from ridgewater.session import new_table_path
from ridgewater.streaming import feeds, state


def _stream(spark, sf):
    """The event table as a stream."""
    schema = v.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_rain_totals(spark, sf):
    """Three-hour totals per user cell; windows still open at the end of the stream are not emitted."""
    readings = _stream(spark, sf).select(F.col("user_id").alias("cell"), "ts", (F.col("value") / 10.0).alias("mm"))
    out = feeds.run_to_table(feeds.trailing_totals(readings, 3), "rain-totals")
    return out.select("cell", "ts", F.round("mm", 6).alias("mm"))


def stream_latest(spark, sf):
    path, checkpoint = new_table_path(spark, "latest"), new_table_path(spark, "latest-offsets")
    readings = _stream(spark, sf).select(F.col("user_id").alias("cell"), "ts", F.col("value").alias("mm"))
    feeds.latest_readings(spark, readings, path, checkpoint).awaitTermination()
    latest = feeds.newest_batch(spark, path)
    return feeds.with_freshness(latest, F.lit("2024-01-30 20:00:00").cast("timestamp"))


def stream_cooldown(spark, sf):
    alerts = _stream(spark, sf).filter("value >= 100").select(F.col("user_id").alias("alert_key"), "ts")
    return feeds.run_to_table(state.cooled_alerts(alerts), "cooldown", state_store=True)


def stream_status_changes(spark, sf):
    states = _stream(spark, sf).select(
        F.col("user_id").alias("zone"), "ts", st.window_status(F.col("value"), F.lit(50.0), F.lit(100.0)).alias("status")
    )
    return feeds.run_to_table(state.status_changes(states), "changes", state_store=True)


def stream_rate_limit(spark, sf):
    calls = _stream(spark, sf).select(F.col("user_id").alias("client"), F.col("event_id").alias("call_id"), "ts")
    out = feeds.run_to_table(state.rate_limited(calls, 5, 86_400), "limits", state_store=True)
    return out.groupBy("client").agg(F.sum(F.col("accepted").cast("long")).alias("n_accepted"), F.count(F.lit(1)).alias("n_calls"))


def stream_send_quota(spark, sf):
    requests = _stream(spark, sf).filter("event_type = 'purchase'").select(
        F.concat(F.lit("gateway-"), F.col("user_id") % 16).alias("gateway"), F.col("event_id").alias("request_id"), "ts",
        F.array(F.col("user_id").cast("string"), ((F.col("user_id") * 7) % 50).cast("string")).alias("recipients"),
    )
    out = feeds.run_to_table(state.send_quota(requests, daily=6), "quota", state_store=True)
    return out.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def stream_report_states(spark, sf):
    """Final state of every report from the state stream, expiries included."""
    ev = rp.attach_reports(_report_events(spark, sf)).select(
        "report_id", "event_id", "ts", "action", F.col("client").cast("string").alias("client")
    ).filter("report_id IS NOT NULL")
    path = new_table_path(spark, "report-events")
    ev.write.parquet(path)
    stream = spark.readStream.schema(ev.schema).parquet(path)
    out = feeds.run_to_table(state.report_states(stream), "report-states", state_store=True)
    last = out.groupBy("report_id").agg(F.max(F.struct("ts", F.col("state") != "active", "confirmations", "state")).alias("r"))
    return last.select("report_id", "r.state", F.col("r.confirmations").cast("long").alias("confirmations"))


def stream_confirmations(spark, sf):
    ev = _stream(spark, sf).filter("event_type = 'click'").select(
        (F.col("user_id") % 10).alias("report_id"), F.col("user_id").alias("client"), F.lit("confirmed").alias("action"), "ts"
    )
    out = feeds.run_to_table(state.confirmations(ev, "60 days"), "confirmations", state_store=True)
    return out.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_clients"))


def stream_episodes(spark, sf):
    days = _stream(spark, sf).filter("event_type = 'error' AND value > 150").select((F.col("user_id") % 50).alias("district"), F.date_trunc("day", "ts").alias("ts"))
    out = feeds.run_to_table(feeds.episodes(days, "1 hour"), "episodes")
    return out.select("district", F.to_date("start").alias("start"), F.to_date("last").alias("last"), "n")


_END = "(SELECT max(ts) FROM events)"

QUERIES = {
    "stream_rain_totals": (
        stream_rain_totals,
        f"""SELECT user_id AS cell, w AS ts, round(sum(value/10e0), 6) AS mm FROM (SELECT user_id, value,
        unnest([date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 2 HOUR, date_trunc('hour', ts) + INTERVAL 3 HOUR]) AS w FROM events)
        WHERE w <= {_END} - INTERVAL 2 HOUR GROUP BY 1,2""",
    ),
    "stream_latest": (
        stream_latest,
        """SELECT user_id AS cell, max(ts) AS ts, arg_max(value, ts) AS mm, max(ts) < TIMESTAMP '2024-01-30 17:00:00' AS is_stale FROM events GROUP BY 1""",
    ),
    "stream_cooldown": (
        stream_cooldown,
        v.sql(
            "",
            "SELECT zone AS alert_key, ts FROM s",
            a="SELECT user_id AS zone, ts FROM events WHERE value >= 100",
            s="""s(zone, ts) USING KEY (zone, ts) AS (SELECT zone, min(ts) FROM a GROUP BY 1 UNION
            SELECT s.zone, min(a.ts) FROM s JOIN a ON a.zone = s.zone AND date_trunc('millisecond', a.ts) >= date_trunc('millisecond', s.ts) + INTERVAL 6 HOUR GROUP BY s.zone, s.ts)""",
        ),
    ),
    "stream_status_changes": (
        stream_status_changes,
        """SELECT zone, ts, status, previous FROM (SELECT zone, ts, status, lag(status) OVER w AS previous, row_number() OVER w AS r FROM (
        SELECT user_id AS zone, ts, CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 50 THEN 'WATCH' ELSE 'SAFE' END AS status FROM events)
        WINDOW w AS (PARTITION BY zone ORDER BY ts)) WHERE r = 1 OR previous <> status""",
    ),
    "stream_rate_limit": (stream_rate_limit, None),
    "stream_send_quota": (stream_send_quota, None),
    "stream_report_states": (stream_report_states, None),
    "stream_confirmations": (
        stream_confirmations,
        "SELECT user_id % 10 AS report_id, count(DISTINCT user_id) AS n_clients FROM events WHERE event_type = 'click' GROUP BY 1",
    ),
    "stream_episodes": (
        stream_episodes,
        """SELECT district, min(day) AS start, max(day) AS last, sum(c)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY district ORDER BY day) AS e FROM (
        SELECT district, day, c, CASE WHEN day - lag(day) OVER (PARTITION BY district ORDER BY day) <= 3 THEN 0 ELSE 1 END AS fresh FROM (
        SELECT user_id % 50 AS district, ts::DATE AS day, count(*) AS c FROM events WHERE event_type = 'error' AND value > 150 GROUP BY 1,2)))
        GROUP BY district, e HAVING max(day) + INTERVAL 84 HOUR <= (SELECT max(ts::DATE) FROM events WHERE event_type = 'error' AND value > 150) - INTERVAL 1 HOUR""",
    ),
}
