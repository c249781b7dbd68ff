"""Registered queries on verification and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgewater.operators import calibrate as cal
from ridgewater.operators import rain as rn
from ridgewater.operators import verify as ver
from ridgewater.operators.scale import exact_quantiles
from ridgewater.plans import views as v
from ridgewater.session import stage

TARGETS = [0.05, 0.10, 0.15, 0.20, 0.30]
WINDOWS = ["value", "value2"]


def _r(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _flagged(spark, sf):
    return v.case_days(spark, sf).withColumn("flag", F.col("value") >= 300000.0)


def skill_scores(spark, sf):
    return _r(ver.confusion(_flagged(spark, sf), "flag", "label", ["year"], rounded=False), "pod", "pofd", "far", "tss")


def classifier_report(spark, sf):
    scored = v.case_days(spark, sf).withColumn("prob", F.col("value") / 500000.0)
    out = ver.classifier_report(scored, "prob", "label", 0.6, ["district"])
    return _r(out, *[c for c in out.columns if c not in ("district", "tp", "fp", "fn", "tn")])


def roc_auc(spark, sf):
    return _r(ver.roc_auc(v.case_days(spark, sf), "value", "label", ["district"]), "auc", "p_value")


def roc_auc_all(spark, sf):
    return _r(ver.roc_auc(v.case_days(spark, sf), "value2", "label"), "auc", "p_value")


def average_precision(spark, sf):
    return _r(ver.average_precision(v.case_days(spark, sf), "value", "label", ["district"]), "average_precision")


def average_ranks(spark, sf):
    part = v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"))
    return ver.average_rank(part, "x", ["grp"])


def best_f1(spark, sf):
    scored = v.case_days(spark, sf).withColumn("prob", F.round(F.col("value") / 500000.0, 4))
    return _r(ver.best_f1(scored, "prob", "label"), "threshold", "f1")


def exact_quantile(spark, sf):
    out = exact_quantiles(v.case_days(spark, sf), ["district"], "value", [0.025, 0.5, 0.9, 0.99])
    return _r(out, "quantile").select("district", "p", "n", "quantile")


def correlation_by_group(spark, sf):
    out = v.case_days(spark, sf).groupBy("district").agg(
        F.corr("value", "value2").alias("correlation"), F.median("value").alias("median_value"),
        F.stddev_pop("value").alias("std"), F.count_distinct("year").alias("n_years"),
    )
    return _r(out, "correlation", "median_value", "std")


def coverage(spark, sf):
    hourly = v.rain(spark, sf)
    return _r(ver.coverage(hourly, ["point_id", "ts", "mm"]), "share")


def group_weights(spark, sf):
    out = ver.group_weights(v.case_days(spark, sf).select("case_id", "district"), "district")
    return _r(out.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight")), "weight")


def rarity_other_years(spark, sf):
    cases = v.case_days(spark, sf)
    out = cal.other_years_share(cases, cases, ["district"], "value", "year", "case_id")
    return _r(out.select("case_id", "district", "year", "share"), "share")


def fixed_false_alarm_loyo(spark, sf):
    out = cal.fixed_false_alarm(v.case_days(spark, sf), WINDOWS, [0.10, 0.20], "case_id")
    return _r(out, "score", "cut").select("case_id", "year", "label", "target", "score", "cut", "flag")


def operating_curve(spark, sf):
    out = cal.operating_curve(v.case_days(spark, sf), WINDOWS, TARGETS, "case_id")
    return _r(out, "pod", "pofd", "far", "tss")


def thresholds_all_years(spark, sf):
    return _r(cal.thresholds_at(v.case_days(spark, sf), WINDOWS, 0.10, "case_id"), "p", "threshold")


def best_threshold(spark, sf):
    return _r(ver.best_threshold(v.case_days(spark, sf), "value", "label", ["district"]), "threshold", "tss")


def best_tss_loyo(spark, sf):
    return _r(cal.best_tss_by_year(v.case_days(spark, sf), WINDOWS), "threshold", "tss")


def best_tss_flags(spark, sf):
    out = cal.leave_one_year_out(v.case_days(spark, sf), WINDOWS, "case_id")
    return _r(ver.confusion(out, "flag", "label", ["year"], rounded=False), "pod", "pofd", "far", "tss")


def baseline_flags(spark, sf):
    cases = v.case_days(spark, sf)
    limits = v.table(spark, sf, "supplier").select(
        (F.col("s_nationkey") % 13).alias("district"),
        F.explode(F.map_from_arrays(F.array(F.lit("value"), F.lit("value2")), F.array(F.abs("s_acctbal") * 40 + 100000.0, F.lit(900.0)))).alias("window_name", "threshold"),
    )
    out = cal.baseline_flags(cases, limits, WINDOWS, "case_id")
    return out.groupBy("district").agg(
        F.sum(F.col("flag").cast("int")).alias("n_flagged"), F.sum(F.col("covered").cast("int")).alias("n_covered"), F.count(F.lit(1)).alias("n")
    )


def event_episodes(spark, sf):
    return cal.build_episodes(v.episode_days(spark, sf))


def _event_spans(spark, sf):
    """Episodes of high-value error days as events: id, district, start, end, kind."""
    severe = v.events(spark, sf).filter("event_type = 'error' AND value > 150")
    days = severe.select((F.col("user_id") % 13).alias("district"), F.to_date("ts").alias("day")).distinct()
    ep = cal.build_episodes(days)
    return ep.select(
        F.format_string("%d-%s", "district", F.col("start").cast("string")).alias("event_id"), "district", "start", "end",
        F.when(F.dayofmonth("start") % 3 == 0, "glacier").otherwise("rain").alias("kind"),
    )


def _frame(spark, sf):
    hourly = v.rain(spark, sf).select(
        (F.col("point_id") % 13).alias("district"), "point_id", F.year("ts").alias("year"), "ts", "mm"
    )
    # The test record is January; it is moved to July so that the season test applies.
    out = rn.district_days(hourly).withColumn("day", F.add_months("day", 6))
    return out


def event_labels(spark, sf):
    events = _event_spans(spark, sf).withColumn("start", F.add_months("start", 6)).withColumn("end", F.add_months("end", 6))
    out = cal.label_days(_frame(spark, sf), events, ["1h", "3h", "24h"], ["antecedent_5d", "year"])
    return out.select(
        "event_id", "district", "day", "year", "label", *[F.round(w, 6).alias(f"w{w}") for w in ("1h", "3h", "24h")],
        F.round("antecedent_5d", 6).alias("antecedent_5d"),
    )


def _paired(spark, sf):
    """Daily maxima of a series and of a second one derived from it, per point and day."""
    peaks = rn.daily_maxima(v.rain(spark, sf), ["point_id"], 3)
    return peaks.select(
        "point_id", "day", F.col("peak_mm").alias("archive"), (F.col("peak_mm") * F.lit(1.25) + F.col("point_id") % 7).alias("live"),
        F.lit("3h").alias("window_name"),
    )


LEVELS = [i / 20 for i in range(1, 20)]


def bias_table(spark, sf):
    out = cal.bias_table(stage(_paired(spark, sf), "pairs"), LEVELS, ["window_name"])
    return out.select(
        "window_name", "n", F.round("correlation", 6).alias("correlation"), F.round("p99_ratio", 6).alias("p99_ratio"),
        F.round(F.element_at("archive_quantiles", 10), 6).alias("archive_median"), F.round(F.element_at("live_quantiles", 10), 6).alias("live_median"),
    )


def quantile_map(spark, sf):
    """Every daily maximum in live units through the matched quantiles."""
    pairs = stage(_paired(spark, sf), "pairs")
    bias = cal.bias_table(pairs, LEVELS, ["window_name"]).withColumn("levels", F.array(*[F.lit(x) for x in LEVELS]))
    mapped = pairs.join(F.broadcast(bias), "window_name")  # one row per window
    out = cal.to_live_units(F.col("archive"), F.col("archive_quantiles"), F.col("live_quantiles"), F.col("levels"))
    return mapped.select("point_id", "day", F.round(out, 6).alias("live_mm"))


def point_thresholds(spark, sf):
    hourly = v.rain(spark, sf).withColumn("year", F.year("ts"))
    rarity = {"watch": {w: 0.90 for w in rn.FLOOD_WINDOWS}, "critical": {w: 0.99 for w in rn.FLOOD_WINDOWS}}
    return _r(cal.point_thresholds(hourly, rn.FLOOD_WINDOWS, rarity), "watch", "critical")


def relative_predictors(spark, sf):
    """District-day rarity; each third of the record stands for a year."""
    hourly = v.rain(spark, sf).select(
        (F.col("point_id") % 13).alias("district"), "point_id", F.expr("2000 + dayofmonth(ts) div 11").alias("year"), "ts", "mm"
    )
    out = cal.relative_predictors(hourly)
    return _r(out, "1h_rel", "3h_rel", "24h_rel").withColumnsRenamed({"1h_rel": "rel_1h", "3h_rel": "rel_3h", "24h_rel": "rel_24h"})


def _flag_counts(truth: str, flag: str) -> str:
    return f"""count(*) FILTER ({flag} AND {truth}) AS hits, count(*) FILTER (NOT {flag} AND {truth}) AS misses,
    count(*) FILTER ({flag} AND NOT {truth}) AS false_alarms, count(*) FILTER (NOT {flag} AND NOT {truth}) AS correct_negatives"""


_SCORES = """round(hits/greatest(1, hits+misses), 6) AS pod, round(false_alarms/greatest(1, false_alarms+correct_negatives), 6) AS pofd,
  round(false_alarms/greatest(1, hits+false_alarms), 6) AS far,
  round(hits/greatest(1, hits+misses) - false_alarms/greatest(1, false_alarms+correct_negatives), 6) AS tss"""
_TAIL = """(t*exp(-(z/sqrt(2e0))*(z/sqrt(2e0)) - 1.26551223e0 + t*(1.00002368e0 + t*(0.37409196e0 + t*(0.09678418e0 + t*(-0.18628806e0
  + t*(0.27886807e0 + t*(-1.13520398e0 + t*(1.48851587e0 + t*(-0.82215223e0 + t*0.17087277e0)))))))))*0.5e0)"""


def _auc(value: str, by: str | None) -> str:
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return v.sql(
        "case_day",
        f"""SELECT {lead}n_pos, n_neg, round(auc, 6) AS auc, round(least(1e0, 2e0*{_TAIL}), 6) AS p_value FROM (
        SELECT *, 1e0/(1e0 + z/sqrt(2e0)*0.5e0) AS t FROM (
        SELECT *, greatest(0e0, (abs(u - n_pos*n_neg/2e0) - 0.5e0)/sqrt(n_pos::DOUBLE*n_neg/12e0*((n+1) - ties/(n*(n-1e0))))) AS z,
          u/(n_pos::DOUBLE*n_neg) AS auc FROM (
        SELECT {lead}sum(label)::BIGINT AS n_pos, (count(*)-sum(label))::BIGINT AS n_neg, count(*) AS n,
          sum(rk*label) - sum(label)*(sum(label)+1)/2e0 AS u, sum((c::DOUBLE*c*c-c)/c) AS ties
        FROM (SELECT *, rank() OVER ({part}ORDER BY {value}) + (c-1)/2e0 AS rk FROM (
          SELECT *, count(*) OVER (PARTITION BY {lead}{value}) AS c FROM case_day)) {group})))""",
    )


_LONG = """SELECT case_id, year, label, 'value' AS window_name, value AS x FROM case_day
  UNION ALL SELECT case_id, year, label, 'value2', value2 FROM case_day"""
_FOLD = f"""SELECT f, case_id, year, label, max(cnt/n) AS score FROM (SELECT f, case_id, year, label,
  sum((label = 0 AND year <> f)::INT) OVER (PARTITION BY f, window_name ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt,
  (SELECT count(*) FROM case_day d WHERE d.label = 0 AND d.year <> f)::DOUBLE AS n
  FROM long CROSS JOIN (SELECT DISTINCT year AS f FROM case_day)) GROUP BY ALL"""


def _ffa(targets: list[float], body: str) -> str:
    rows = ",".join(f"({t}e0)" for t in targets)
    return v.sql(
        "case_day",
        body,
        long=_LONG,
        fold=_FOLD,
        cut=f"""SELECT f, target, quantile_cont(score, [{','.join(repr(1.0 - t) for t in targets)}]) AS qs FROM fold,
        (VALUES {rows}) t(target) WHERE label = 0 AND year <> f GROUP BY 1,2""",
        cuts="SELECT f, target, qs[list_position([" + ",".join(f"{t}e0" for t in targets) + "], target)] AS cut FROM cut",
        own="SELECT case_id, year, label, target, score, cut, score > cut AS flag FROM fold JOIN cuts USING (f) WHERE year = f",
    )


_PAIR = f"""SELECT point_id, day, peak AS archive, peak*1.25e0 + point_id % 7 AS live FROM (SELECT point_id, ts::DATE AS day, max(t) AS peak
  FROM (SELECT point_id, ts, sum(coalesce(mm,0e0)) OVER (PARTITION BY point_id ORDER BY ts ROWS 2 PRECEDING) AS t FROM rain)
  GROUP BY 1,2 HAVING count(*) = 24)"""
_LEVELS = "[" + ",".join(repr(x) + "e0" for x in LEVELS) + "]"
_TSS = """SELECT f AS fold, window_name, t AS threshold, tss FROM (SELECT *, row_number() OVER (PARTITION BY f, window_name ORDER BY tss DESC, t) AS r FROM (
  SELECT f, window_name, x AS t, h/n1::DOUBLE - fa/n0::DOUBLE AS tss, cand FROM (SELECT f, window_name, x,
    sum((label = 1)::INT) OVER w AS h, sum((label = 0)::INT) OVER w AS fa, label = 1 AS cand,
    sum((label = 1)::INT) OVER (PARTITION BY f, window_name) AS n1, sum((label = 0)::INT) OVER (PARTITION BY f, window_name) AS n0
    FROM long CROSS JOIN (SELECT DISTINCT year AS f FROM case_day) WHERE year <> f
    WINDOW w AS (PARTITION BY f, window_name ORDER BY x DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) WHERE cand) WHERE r = 1"""
_EPISODE = """SELECT district, min(day) AS start, least(max(day), min(day) + 6) AS "end", count(*) AS n_days FROM (
  SELECT district, day, sum(fresh) OVER (PARTITION BY district ORDER BY day) AS e FROM (
  SELECT district, day, CASE WHEN day - lag(day) OVER (PARTITION BY district ORDER BY day) <= 3 THEN 0 ELSE 1 END AS fresh
  FROM {src})) GROUP BY district, e"""

QUERIES = {
    "skill_scores": (
        skill_scores,
        v.sql("case_day", f"SELECT *, {_SCORES} FROM (SELECT year, {_flag_counts('label = 1', 'value >= 300000')} FROM case_day GROUP BY 1)"),
    ),
    "classifier_report": (
        classifier_report,
        v.sql(
            "case_day",
            f"""SELECT district, hits AS tp, false_alarms AS fp, misses AS fn, correct_negatives AS tn, round(brier, 6) AS brier,
            round((hits+correct_negatives)/n, 6) AS accuracy,
            round((hits/greatest(1,hits+misses) + correct_negatives/greatest(1,correct_negatives+false_alarms))/2e0, 6) AS balanced_accuracy,
            round(hits/greatest(1,hits+false_alarms), 6) AS precision, round(hits/greatest(1,hits+misses), 6) AS recall,
            round(2e0*hits/greatest(1,2*hits+false_alarms+misses), 6) AS f1,
            round(greatest(hits+misses, false_alarms+correct_negatives)/n, 6) AS majority_baseline
            FROM (SELECT district, count(*) AS n, avg(power(value/500000e0-label, 2)) AS brier,
            {_flag_counts('label = 1', 'value/500000e0 >= 0.6e0')} FROM case_day GROUP BY 1)""",
        ),
    ),
    "roc_auc": (roc_auc, _auc("value", "district")),
    "roc_auc_all": (roc_auc_all, _auc("value2", None)),
    "average_precision": (
        average_precision,
        v.sql(
            "case_day",
            """SELECT district, round(sum(pos*hits/flagged)/greatest(1, sum(pos)), 6) AS average_precision FROM (
            SELECT district, value, pos, sum(pos) OVER w AS hits, sum(c) OVER w AS flagged FROM (
              SELECT district, value, count(*) AS c, sum(label) AS pos FROM case_day GROUP BY 1,2)
            WINDOW w AS (PARTITION BY district ORDER BY value DESC)) GROUP BY 1""",
        ),
    ),
    "average_ranks": (
        average_ranks,
        """SELECT l_returnflag AS grp, l_quantity AS x, count(*) AS n, min(rk) AS avg_rank FROM (
        SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
          + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1)/2e0 AS rk FROM lineitem) GROUP BY 1,2""",
    ),
    "best_f1": (
        best_f1,
        v.sql(
            "case_day",
            """SELECT t/100e0 AS threshold, round(2e0*tp/(f+n1), 6) AS f1 FROM (SELECT t, count(*) FILTER (b >= t) AS f,
            count(*) FILTER (b >= t AND label = 1) AS tp, count(*) FILTER (label = 1) AS n1
            FROM (SELECT floor(round(value/500000e0, 4)*100e0 + 1e-9)::INT AS b, label FROM case_day),
            (SELECT unnest(generate_series(5, 94)) AS t) GROUP BY 1) ORDER BY 2e0*tp/(f+n1) DESC, t LIMIT 1""",
        ),
    ),
    "exact_quantile": (
        exact_quantile,
        v.sql(
            "case_day",
            """SELECT district, unnest([0.025e0,0.5e0,0.9e0,0.99e0]) AS p, n, round(unnest(q), 6) AS quantile FROM (
            SELECT district, count(*) AS n, quantile_cont(value, [0.025,0.5,0.9,0.99]) AS q FROM case_day GROUP BY 1)""",
        ),
    ),
    "correlation_by_group": (
        correlation_by_group,
        v.sql(
            "case_day",
            """SELECT district, round(corr(value, value2), 6) AS correlation, round(median(value), 6) AS median_value,
            round(stddev_pop(value), 6) AS std, count(DISTINCT year) AS n_years FROM case_day GROUP BY 1""",
        ),
    ),
    "coverage": (
        coverage,
        v.sql(
            "rain",
            """SELECT 'point_id' AS "column", round(avg((point_id IS NOT NULL)::INT), 6) AS share FROM rain
            UNION ALL SELECT 'ts', round(avg((ts IS NOT NULL)::INT), 6) FROM rain
            UNION ALL SELECT 'mm', round(avg((mm IS NOT NULL)::INT), 6) FROM rain""",
        ),
    ),
    "group_weights": (
        group_weights,
        v.sql(
            "case_day",
            """SELECT district, n, round(1e0/n/avg_inv, 6) AS weight FROM (SELECT district, count(*) AS n FROM case_day GROUP BY 1),
            (SELECT count(DISTINCT district)/count(*) AS avg_inv FROM case_day)""",
        ),
    ),
    "rarity_other_years": (
        rarity_other_years,
        v.sql(
            "case_day",
            """SELECT case_id, district, year, round((a - o)/(n - m), 6) AS share FROM (SELECT case_id, district, year,
            count(*) OVER (PARTITION BY district ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
            count(*) OVER (PARTITION BY district, year ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o,
            count(*) OVER (PARTITION BY district) AS n, count(*) OVER (PARTITION BY district, year) AS m FROM case_day)""",
        ),
    ),
    "fixed_false_alarm_loyo": (
        fixed_false_alarm_loyo,
        _ffa([0.10, 0.20], "SELECT case_id, year, label, target, round(score, 6) AS score, round(cut, 6) AS cut, flag FROM own"),
    ),
    "operating_curve": (
        operating_curve,
        _ffa(TARGETS, f"SELECT *, {_SCORES} FROM (SELECT target, {_flag_counts('label = 1', 'flag')} FROM own GROUP BY 1)"),
    ),
    "best_threshold": (
        best_threshold,
        v.sql(
            "case_day",
            """SELECT district, threshold, round(tss, 6) AS tss FROM (SELECT district, x AS threshold, h/n1 - fa/n0 AS tss,
            row_number() OVER (PARTITION BY district ORDER BY h/n1 - fa/n0 DESC, x) AS r FROM (SELECT district, value AS x, label,
            sum(label) OVER w AS h, sum(1-label) OVER w AS fa, sum(label) OVER (PARTITION BY district)::DOUBLE AS n1,
            sum(1-label) OVER (PARTITION BY district)::DOUBLE AS n0 FROM case_day
            WINDOW w AS (PARTITION BY district ORDER BY value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE label = 1) WHERE r = 1""",
        ),
    ),
    "best_tss_loyo": (
        best_tss_loyo,
        v.sql("case_day", "SELECT fold, window_name, round(threshold, 6) AS threshold, round(tss, 6) AS tss FROM best", long=_LONG, best=_TSS),
    ),
    "best_tss_flags": (
        best_tss_flags,
        v.sql(
            "case_day",
            f"""SELECT *, {_SCORES} FROM (SELECT year, {_flag_counts('label = 1', 'flag')} FROM (
            SELECT case_id, year, label, bool_or(x >= threshold) AS flag FROM long l JOIN best b ON b.fold = l.year AND b.window_name = l.window_name
            GROUP BY 1,2,3) GROUP BY 1)""",
            long=_LONG,
            best=_TSS,
        ),
    ),
    "baseline_flags": (
        baseline_flags,
        v.sql(
            "case_day",
            """SELECT district, sum((value >= t1 OR value2 >= 900)::INT)::BIGINT AS n_flagged, count(*) AS n_covered, count(*) AS n
            FROM case_day JOIN (SELECT s_nationkey % 13 AS district, min(abs(s_acctbal)*40+100000e0) AS t1 FROM supplier GROUP BY 1) USING (district) GROUP BY 1
            UNION ALL SELECT district, 0, 0, count(*) FROM case_day WHERE district NOT IN (SELECT s_nationkey % 13 FROM supplier) GROUP BY 1""",
        ),
    ),
    "event_episodes": (event_episodes, v.sql("episode_day", _EPISODE.format(src="episode_day"))),
    "event_labels": (
        event_labels,
        v.sql(
            "rain",
            """SELECT e.event_id, e.district, min(f.day) AS day, min(f.year) AS year, 1::INT AS label, max(w1h) AS w1h, max(w3h) AS w3h, max(w24h) AS w24h,
              arg_min(antecedent_5d, f.day) AS antecedent_5d FROM ev e JOIN frame f ON f.district = e.district AND f.day BETWEEN e.start AND e."end"
              WHERE kind = 'rain' GROUP BY 1,2
            UNION ALL SELECT NULL, district, day, year, 0, w1h, w3h, w24h, antecedent_5d FROM frame f WHERE NOT EXISTS (
              SELECT 1 FROM ev e WHERE e.district = f.district AND f.day BETWEEN e.start - 3 AND e."end" + 3)""",
            d0="SELECT DISTINCT user_id % 13 AS district, ts::DATE AS day FROM events WHERE event_type = 'error' AND value > 150",
            ep=_EPISODE.format(src="d0"),
            ev="""SELECT district || '-' || start AS event_id, district, (start + INTERVAL 6 MONTH)::DATE AS start, ("end" + INTERVAL 6 MONTH)::DATE AS "end",
            CASE WHEN day(start) % 3 = 0 THEN 'glacier' ELSE 'rain' END AS kind FROM ep""",
            run="""SELECT point_id, ts, coalesce(mm,0e0) AS w1, sum(coalesce(mm,0e0)) OVER (PARTITION BY point_id ORDER BY ts ROWS 2 PRECEDING) AS w3,
            sum(coalesce(mm,0e0)) OVER (PARTITION BY point_id ORDER BY ts ROWS 23 PRECEDING) AS w24 FROM rain""",
            peak="""SELECT point_id, day, max(w1) AS w1, max(w3) AS w3, max(w24) AS w24 FROM (
            SELECT *, ts::DATE AS day FROM run UNION ALL SELECT *, ts::DATE + 1 AS day FROM run) GROUP BY 1,2 HAVING count(*) = 48""",
            ante="""SELECT point_id, d + k AS day, sum(mm) AS mm FROM (SELECT point_id, ts::DATE AS d, sum(mm) AS mm FROM rain GROUP BY 1,2)
            CROSS JOIN (SELECT unnest([2,3,4,5,6]) AS k) GROUP BY 1,2""",
            frame="""SELECT p.point_id % 13 AS district, (p.day + INTERVAL 6 MONTH)::DATE AS day, year(p.day) AS year, round(max(w1),6) AS w1h,
            round(max(w3),6) AS w3h, round(max(w24),6) AS w24h, round(avg(coalesce(a.mm, 0e0)),6) AS antecedent_5d
            FROM peak p LEFT JOIN ante a USING (point_id, day) GROUP BY 1,2,3""",
        ),
    ),
    "bias_table": (
        bias_table,
        v.sql(
            "rain",
            """SELECT '3h' AS window_name, count(*) AS n, round(corr(archive, live), 6) AS correlation,
            round(quantile_cont(live, 0.99)/greatest(quantile_cont(archive, 0.99), 1e-6), 6) AS p99_ratio,
            round(quantile_cont(archive, 0.5), 6) AS archive_median, round(quantile_cont(live, 0.5), 6) AS live_median FROM pr""",
            pr=_PAIR,
        ),
    ),
    "quantile_map": (
        quantile_map,
        v.sql(
            "rain",
            f"""SELECT point_id, day, round(CASE WHEN archive >= aq[19] THEN archive*lq[19]/aq[19] WHEN j = 0 THEN lq[1]
            ELSE lq[k] + (lq[k+1]-lq[k])*(lv-lev[k])/(lev[k+1]-lev[k]) END, 6) AS live_mm FROM (
              SELECT *, greatest(1, least(18, len(list_filter(lev, lambda e: e <= lv)))) AS k FROM (
              SELECT *, CASE WHEN j = 0 THEN lev[1] ELSE lev[j] + (lev[j+1]-lev[j])*(archive-aq[j])/(aq[j+1]-aq[j]) END AS lv FROM (
              SELECT *, len(list_filter(aq, lambda e: e <= archive)) AS j, {_LEVELS} AS lev FROM pr, (SELECT quantile_cont(archive, {_LEVELS}) AS aq,
                quantile_cont(live, {_LEVELS}) AS lq FROM pr))))""",
            pr=_PAIR,
        ),
    ),
    "point_thresholds": (
        point_thresholds,
        v.sql(
            "rain",
            """SELECT point_id, w AS window_name, round(quantile_cont(t, 0.9), 6) AS watch, round(quantile_cont(t, 0.99), 6) AS critical FROM (
            SELECT point_id, '1h' AS w, coalesce(mm,0e0) AS t FROM rain
            UNION ALL SELECT point_id, '3h', sum(coalesce(mm,0e0)) OVER (PARTITION BY point_id, year(ts) ORDER BY ts ROWS 2 PRECEDING) FROM rain
            UNION ALL SELECT point_id, '24h', sum(coalesce(mm,0e0)) OVER (PARTITION BY point_id, year(ts) ORDER BY ts ROWS 23 PRECEDING) FROM rain) GROUP BY 1,2""",
        ),
    ),
    "relative_predictors": (
        relative_predictors,
        v.sql(
            "rain",
            """SELECT point_id % 13 AS district, year, day, round(max(CASE w WHEN '1h' THEN share END), 6) AS rel_1h,
            round(max(CASE w WHEN '3h' THEN share END), 6) AS rel_3h, round(max(CASE w WHEN '24h' THEN share END), 6) AS rel_24h FROM (
            SELECT p.point_id, p.year, p.day, p.w, (SELECT 1) AS one, s.share FROM pk p JOIN sh s ON s.point_id = p.point_id AND s.year = p.year AND s.w = p.w AND s.t = p.t)
            GROUP BY 1,2,3""",
            h="SELECT point_id, 2000 + day(ts) // 11 AS year, ts, coalesce(mm,0e0) AS mm FROM rain",
            tot="""SELECT point_id, year, ts, '1h' AS w, mm AS t FROM h
            UNION ALL SELECT point_id, year, ts, '3h', sum(mm) OVER (PARTITION BY point_id, year ORDER BY ts ROWS 2 PRECEDING) FROM h
            UNION ALL SELECT point_id, year, ts, '24h', sum(mm) OVER (PARTITION BY point_id, year ORDER BY ts ROWS 23 PRECEDING) FROM h""",
            sh="""SELECT DISTINCT point_id, year, w, t, (count(*) OVER (PARTITION BY point_id, w ORDER BY t RANGE UNBOUNDED PRECEDING)
              - count(*) OVER (PARTITION BY point_id, w, year ORDER BY t RANGE UNBOUNDED PRECEDING))
              / (count(*) OVER (PARTITION BY point_id, w) - count(*) OVER (PARTITION BY point_id, w, year)) AS share FROM tot""",
            pk="""SELECT point_id, year, day, w, max(t) AS t FROM (SELECT *, ts::DATE AS day FROM tot UNION ALL SELECT *, ts::DATE + 1 FROM tot)
            GROUP BY 1,2,3,4 HAVING count(*) = 48""",
        ),
    ),
}
_Q = "(SELECT s[f+1] + (s[least(f+2, len(s))] - s[f+1])*(h - f) FROM (SELECT s, p*(len(s)-1) AS h, floor(p*(len(s)-1))::BIGINT AS f FROM (SELECT list_sort(list({c})) AS s FROM case_day WHERE label = 0), pp))"
QUERIES["thresholds_all_years"] = (
    thresholds_all_years,
    v.sql(
        "case_day",
        f"""SELECT 'value' AS window_name, round(p, 6) AS p, round({_Q.format(c='value')}, 6) AS threshold FROM pp
        UNION ALL SELECT 'value2', round(p, 6), round({_Q.format(c='value2')}, 6) FROM pp""",
        pp="""SELECT quantile_cont(s, 0.9) AS p FROM (SELECT greatest(a, b)/n AS s FROM (SELECT
        count(*) OVER (ORDER BY value RANGE UNBOUNDED PRECEDING) AS a, count(*) OVER (ORDER BY value2 RANGE UNBOUNDED PRECEDING) AS b,
        count(*) OVER () AS n FROM case_day WHERE label = 0))""",
    ),
)
