import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgewater.functions import status as st
from ridgewater.operators import alerts as al
from ridgewater.operators import rain as rn
from ridgewater.operators import reports as rp


def payload(hours, after=(), current="2024-06-03T00:00"):
    start = dt.datetime(2024, 6, 3) - dt.timedelta(hours=len(hours) - 1)
    values = list(hours) + list(after)
    times = [(start + dt.timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M") for i in range(len(values))]
    import json

    return json.dumps({"latitude": 30.0, "longitude": 79.0, "current": {"time": current, "precipitation": 0.0},
                       "hourly": {"time": times, "precipitation": values}})


def reading(spark, text):
    parsed = rn.parse_payload(spark.createDataFrame([(1, text)], "id int, payload string"))
    return rn.readings_now(parsed, ["id", "location"]).first()


@pytest.mark.parametrize("clock", ["2024-06-03T00:00", "2024-06-03T00:30"])
def test_forecast_windows(spark, clock):
    r = reading(spark, payload([1.0] * 48, [2.0, 4.0, 0.0], clock))
    assert (r["1h"], r["3h"], r["24h"], r["antecedent_48h"]) == (1.0, 3.0, 24.0, 48.0)
    assert [(f["1h"], f["3h"], f["24h"]) for f in r.forecast] == [(2.0, 4.0, 25.0), (4.0, 7.0, 28.0), (0.0, 6.0, 27.0)]


def test_no_future_and_short_history(spark):
    r = reading(spark, payload([1.0] * 48))
    assert r.forecast == [] and r["72h"] is None and r["168h"] is None
    short = reading(spark, payload([1.0] * 10))
    assert short["24h"] is None and short["3h"] == 3.0


def test_payload_list_gives_locations(spark):
    text = "[" + payload([1.0] * 3) + "," + payload([2.0] * 3) + "]"
    parsed = rn.parse_payload(spark.createDataFrame([(text,)], "payload string"))
    assert {(r.location, r.mm) for r in parsed.select("location", "mm").distinct().collect()} == {(0, 1.0), (1, 2.0)}


def test_null_rules_of_windows(spark):
    rows = [(1, dt.datetime(2024, 1, 1, h), mm) for h, mm in enumerate([None, 2.0, None, 4.0])]
    df = spark.createDataFrame(rows, "point_id int, ts timestamp, mm double")
    k = ["point_id"]
    got = df.select("ts", rn.running_total(2, k).alias("a"), rn.full_total(2, k).alias("b"), rn.present_total(2, k).alias("c")).orderBy("ts").collect()
    assert [tuple(r)[1:] for r in got] == [(0.0, None, None), (2.0, 2.0, 2.0), (2.0, 2.0, 2.0), (4.0, 4.0, 4.0)]


def test_thresholds_are_ordered():
    for table in st.CLASS_THRESHOLDS.values():
        assert all(w < c for w, c in table.values())
        assert table["1h"][1] < table["3h"][1] < table["24h"][1]
    for a, b in zip(st.CLASS_ORDER, st.CLASS_ORDER[1:]):
        assert all(st.CLASS_THRESHOLDS[a][w][1] > st.CLASS_THRESHOLDS[b][w][1] for w in ("1h", "3h", "24h"))


def test_status_and_multipliers(spark):
    one = spark.range(1)
    row = one.select(
        st.window_status(F.lit(8.0), F.lit(4.0), F.lit(8.0)).alias("a"), st.window_status(F.lit(None).cast("double"), F.lit(4.0), F.lit(8.0)).alias("b"),
        st.worst_status(F.lit("SAFE"), F.lit("WATCH"), F.lit(None).cast("string")).alias("c"), st.worst_status(F.lit(None).cast("string")).alias("d"),
        st.antecedent_multiplier(F.lit(50.0)).alias("e"), st.antecedent_multiplier(F.lit(None).cast("double")).alias("f"),
        st.catchment_multiplier(F.lit(99.0)).alias("g"), st.static_multiplier(F.lit("A"), F.lit(500.0)).alias("h"),
        st.index_band(F.lit(4.5)).alias("i"), st.flood_risk(F.lit(2.0), F.lit(0.5), F.lit(1.0)).alias("j"),
        st.rain_tier(F.lit(5.0), F.array(F.lit(5.0), F.lit(5.0), F.lit(0.0), F.lit(99.0))).alias("k"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("CRITICAL", None, "WATCH", None)
    assert (row.e, row.f, row.g, row.h) == (0.85, 1.0, 0.85, 1.093) or abs(row.h - 1.093) < 1e-3
    assert row.i == "MODERATE" and abs(row.j - 0.7) < 1e-9 and row.k == "HEAVY"


def test_outlook(spark):
    dry, watch, crit = (0.0, 0.0, 0.0), (5.0, 5.0, 5.0), (9.0, 9.0, 9.0)
    steps = F.array(*[F.struct(*[F.lit(x).alias(w) for x, w in zip(s, ("1h", "3h", "24h"))]) for s in (dry, watch, crit, crit)])
    limits = {w: (F.lit(a), F.lit(b)) for w, (a, b) in st.CLASS_THRESHOLDS["EXTREME"].items()}
    best = spark.range(1).select(st.outlook(F.lit(1), steps, limits).alias("o"), st.outlook(F.lit(3), steps, limits).alias("n")).first()
    assert (best.o.status, best.o.in_hours, best.o.window, best.o.threshold_mm) == ("CRITICAL", 3, "1h", 8.0)
    assert best.n is None


def test_cards_spread_over_areas(spark):
    rows = [(1, "CRITICAL", 1, 3010.0), (2, "CRITICAL", 1, 3009.0), (3, "CRITICAL", 2, 3001.0), (4, "WATCH", 1, 2005.0),
            (5, "SAFE", 9, 1000.5), (6, "SAFE", 8, 1000.1), (7, "SAFE", 7, 1000.9), (8, "WATCH", 1, 2001.0)]
    zones = spark.createDataFrame(rows, "zone_id long, status string, area int, risk_key double")
    got = [r.zone_id for r in st.diversified_cards(zones).orderBy("position").collect()]
    assert got == [1, 3, 4, 8, 6]


def test_trust_rule(spark):
    rows = [(0, 0.0, "unverified"), (2, 0.0, "confirmed"), (0, 2.5, "rain"), (0, None, "no_rain_data"), (2, None, "confirmed")]
    df = spark.createDataFrame(rows, "c int, mm double, want string")
    assert df.filter(rp.trust(F.col("c"), F.col("mm")) != F.col("want")).count() == 0


def test_cooldown_counts_from_last_sent(spark):
    times = [0, 1, 5.9, 6, 11.9, 12, 18 - 1 / 3600, 18 + 1 / 3600, 30]
    rows = [("z", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for h in times]
    got = al.cooldown(spark.createDataFrame(rows, "zone string, ts timestamp"), ["zone"])
    assert sorted((r.ts - dt.datetime(2024, 1, 1)).total_seconds() / 3600 for r in got.collect()) == [0, 6, 12, 18 + 1 / 3600, 30]


def test_sql_functions(spark):
    st.register_sql_functions(spark)
    row = spark.sql("SELECT rw_window_status(9, 4, 8) AS s, rw_index_band(7.0) AS b, rw_haversine_km(30, 79, 31, 79) AS km").first()
    assert row.s == "CRITICAL" and row.b == "VERY HIGH" and abs(row.km - 111.195) < 0.01


def test_tier_totals_are_added_in_hour_order(spark):
    """0.216 + 7.688 + 4.25 + 2.846 is 15 hour by hour, and just below when the coming hours are added up first."""
    tier = st.rain_tier(F.lit(0.216), F.array(F.lit(7.688), F.lit(4.25), F.lit(2.846)))
    assert spark.range(1).select(tier.alias("t")).first().t == "HEAVY"


def test_hours_are_filled_from_the_readings_alone(spark):
    """Gaps, a late first and an early last reading, a reading off the hour; only the readings are shuffled."""
    t = lambda h, m=0: dt.datetime(2024, 6, 1) + dt.timedelta(hours=h, minutes=m)
    rows = [(1, t(0), 1.0), (1, t(3), 2.0), (2, t(2), 3.0), (2, t(4), None), (3, t(1, 30), 9.0), (4, t(6), 4.0)]
    observed = spark.createDataFrame(rows, "point_id long, ts timestamp, mm double")
    out = rn.densify(observed)
    known = {(p, ts): mm for p, ts, mm in rows}
    assert sorted((r.point_id, r.ts, r.mm) for r in out.collect()) == [(p, t(h), known.get((p, t(h)))) for p in (1, 2, 3, 4) for h in range(7)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan
