"""Cooldowns, zone limits and live states against brute force, over several micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgewater.operators import alerts as al
from ridgewater.operators import reports as rp
from ridgewater.plans.alert_plans import in_batches
from ridgewater.session import new_table_path
from ridgewater.streaming import feeds, state

START = dt.datetime(2024, 3, 1)


def brute_cooldown(rows, hours=6):
    sent, last = [], {}
    for key, ts in sorted(rows):
        if key not in last or ts - last[key] >= dt.timedelta(hours=hours):
            last[key] = ts
            sent.append((key, ts))
    return sorted(sent)


@pytest.fixture(scope="module")
def alerts():
    rng = random.Random(4)
    rows = [(f"k{i % 5}", START + dt.timedelta(microseconds=rng.randrange(15 * 86_400_000_000))) for i in range(300)]
    rows += [("hot", START + dt.timedelta(minutes=7 * i)) for i in range(2500)]
    rows += [("edge", START), ("edge", START + dt.timedelta(hours=6) - dt.timedelta(microseconds=1)), ("edge", START + dt.timedelta(hours=6)), ("edge", START)]
    return rows


def test_cooldown_by_doubling_equals_a_loop(spark, alerts):
    got = al.cooldown(spark.createDataFrame(alerts, "zone string, ts timestamp").repartition(4), ["zone"])
    assert sorted((r.zone, r.ts) for r in got.collect()) == brute_cooldown(alerts)
    assert al.cooldown(spark.createDataFrame([], "zone string, ts timestamp"), ["zone"]).collect() == []


def test_cooldown_stream_equals_batch(spark, alerts):
    rows = [r for r in alerts if r[0] != "hot"]
    live = in_batches(spark.createDataFrame(rows, "alert_key string, ts timestamp"), "live")
    out = feeds.run_to_table(state.cooled_alerts(live), "sent", state_store=True)
    assert sorted((r.alert_key, r.ts) for r in out.collect()) == brute_cooldown(rows)


def test_zone_limits_fall_back_to_the_class(spark):
    zones = [(1, 30.0, 79.0, "HIGH"), (2, 30.1, 79.1, "EXTREME"), (3, 45.0, 10.0, "EXTREME"), (4, 45.0, 10.0, None)]
    zones = spark.createDataFrame(zones, "zone_id long, lat double, lon double, effective_class string")
    rows = [(7, 30.0, 79.0, w, 10.0 + i, 20.0 + i) for i, w in enumerate(al.WINDOWS)] + [(8, 30.12, 79.1, w, 1.0, 2.0) for w in al.WINDOWS]
    grid = spark.createDataFrame(rows, "target_id long, lat double, lon double, window_name string, watch double, critical double")
    got = {r.zone_id: r for r in al.zone_limits(zones, grid, F.lit(0.5)).collect()}
    assert [got[i].threshold_source for i in (1, 2, 3, 4)] == ["calibrated", "calibrated", "heuristic", None]
    assert (got[1].watch_3h, got[1].critical_24h, got[2].critical_1h) == (11.0, 22.0, 2.0)
    assert got[3].critical_1h is not None and got[4].critical_1h is None


def test_warnings_replaced_before_and_after_their_issue(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [
        ("a", at(0), "Actual", "Alert", "", at(50)), ("b", at(1), "Actual", "Update", "o,a,t o,c,t", None), ("c", at(2), "Actual", "Alert", None, None),
        ("d", at(3), "Test", "Alert", "", None), ("e", at(4), "Actual", "Cancel", "o,b,t", None), ("f", at(5), "Actual", "Alert", "bad", at(6)),
        ("g", at(30), "Actual", "Alert", "", at(29)), ("h", at(40), "Actual", "Alert", "o,zz,t", at(90)),
    ]
    df = spark.createDataFrame(rows, "identifier string, ts timestamp, status string, msg_type string, references string, expires timestamp")
    out = feeds.run_to_table(state.warning_states(in_batches(df, "warn"), "0 seconds"), "warn-out", state_store=True)
    got = {}
    for r in out.orderBy("ts").collect():
        got.setdefault(r.identifier, []).append(r.state)
    assert got == {"a": ["in_force", "replaced"], "b": ["in_force", "replaced"], "f": ["in_force", "expired"], "g": ["expired"], "h": ["in_force"]}
    live = df.withColumn("expires", F.date_format("expires", "yyyy-MM-dd HH:mm:ss")).withColumns({"area": F.lit(""), "headline": F.lit(""), "severity": F.lit("Minor"), "sender": F.lit("o")})
    assert {r.identifier for r in rp.current_warnings(live, F.lit(at(40))).collect()} == {i for i, s in got.items() if s[-1] == "in_force"}


def test_quarantine_by_batch(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [(1, at(0), at(0), 1.0), (2, at(1), at(1), -1.0), (None, at(1), at(1), 1.0), (1, at(40), at(40), 2.0), (3, at(41), at(10), 5.0),
            (1, at(80), at(39), 2.5), (1, at(81), at(37), 2.5), (4, at(90), at(90), None), (4, at(91), at(91), float("nan")), (5, at(92), None, 1.0)]
    live = in_batches(spark.createDataFrame(rows, "cell long, ts timestamp, told timestamp, mm double"), "q").select("cell", F.col("told").alias("ts"), "mm")
    path, aside = new_table_path(spark, "in"), new_table_path(spark, "aside")
    feeds.accept_in_time(live, path, aside, new_table_path(spark, "at")).awaitTermination()
    good, bad = spark.read.parquet(path).collect(), spark.read.parquet(aside).collect()
    assert sorted((r.batch, r.ts) for r in good) == [(0, at(0)), (1, at(10)), (1, at(40)), (2, at(39))]
    assert sorted((r.batch, r.reason) for r in bad) == [(0, "implausible"), (0, "incomplete"), (2, "implausible"), (2, "implausible"), (2, "incomplete"), (2, "late")]


def test_zones_per_warning_equals_the_listed_pairs(spark):
    current = spark.createDataFrame([("a", ["X", "Y"]), ("b", ["Y", "Y"]), ("c", ["Z"])], "identifier string, districts array<string>")
    zones = spark.createDataFrame([(1, "X"), (2, "X"), (3, "Y"), (4, None)], "zone_id long, district string")
    assert {tuple(r) for r in rp.zones_per_warning(current, zones).collect()} == {("a", 3), ("b", 1)}
