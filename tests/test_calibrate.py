import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from ridgewater.operators import calibrate as cal
from ridgewater.operators import models as ml
from ridgewater.operators import sampling as sa
from ridgewater.operators import scale
from ridgewater.operators import verify as ver


def cases(n=600, years=6, seed=1, signal=2.0):
    rng = np.random.default_rng(seed)
    label = (rng.random(n) < 0.1).astype(int)
    a = np.round(rng.gamma(2, 5, n) + label * signal * 5, 1)
    b = np.round(rng.gamma(2, 5, n), 1)
    b[::3] = 0.0  # a third of all values are the same
    year = 2000 + np.arange(n) % years
    return label, a, b, year


def frame(spark, label, a, b, year):
    rows = [(i, int(y), int(lb), float(p), float(q)) for i, (lb, p, q, y) in enumerate(zip(label, a, b, year))]
    return spark.createDataFrame(rows, "row_id long, year int, label int, a double, b double")


def test_running_totals_in_ranges(spark):
    rng = random.Random(3)
    rows = [(g, float(x), rng.randint(1, 9)) for g in range(3) for x in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g int, x double, n int")
    for desc in (False, True):
        got = {(r.g, r.x): r.t for r in scale.running_totals(df, ["g"], "x", {"t": F.col("n")}, descending=desc, buckets=7).collect()}
        for g, x, _ in rows:
            assert got[g, x] == sum(n for h, y, n in rows if h == g and (y >= x if desc else y <= x))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    values = {g: np.round(rng.gamma(1, 9, 501 + g), 1) for g in range(3)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs], "g int, x double")
    probs = [0.0, 0.025, 0.5, 0.9, 0.999, 1.0]
    for r in scale.exact_quantiles(df, ["g"], "x", probs, buckets=5).collect():
        assert abs(r.quantile - np.quantile(values[r.g], r.p)) < 1e-9
    assert abs(scale.exact_quantiles(df.filter("g = 0"), [], "x", [0.3]).first().quantile - np.quantile(values[0], 0.3)) < 1e-9


def test_carry_forward_in_ranges(spark):
    rng = random.Random(4)
    rows = [(i % 2, float(i), i, i if rng.random() < 0.1 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, t double, i int, v int")
    got = {r.i: r.last_v for r in scale.carry_forward(df, ["g"], ["t", "i"], ["v"], buckets=6).collect()}
    for g, _, i, _ in rows:
        assert got[i] == max((v for h, _, j, v in rows if h == g and j <= i and v is not None), default=None)


def test_auc_and_precision(spark):
    label, a, b, year = cases()
    df = frame(spark, label, a, b, year)
    order = np.argsort(b, kind="stable")
    ranks = np.empty(len(b))
    for x in np.unique(b):
        ranks[b == x] = (np.sum(b < x) + np.sum(b <= x) + 1) / 2
    n1, n0 = label.sum(), (1 - label).sum()
    row = ver.roc_auc(df, "b", "label").first()
    assert abs(row.auc - (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) < 1e-9
    assert 0 <= row.p_value <= 1 and len(order) == len(b)
    ap, last = 0.0, 0.0
    for x in sorted(np.unique(a), reverse=True):
        hit, flagged = ((a >= x) & (label == 1)).sum(), (a >= x).sum()
        ap += (hit / n1 - last) * hit / flagged
        last = hit / n1
    assert abs(ver.average_precision(df, "a", "label").first().average_precision - ap) < 1e-9


def reference_rule(label, columns, year, target):
    flags = np.zeros(len(label), bool)
    for y in np.unique(year):
        train, test = year != y, year == y
        dry = train & (label == 0)

        def score(rows):
            return np.max([np.searchsorted(np.sort(c[dry]), c[rows], side="right") / max(1, dry.sum()) for c in columns], axis=0)

        flags[test] = score(test) > np.quantile(score(dry), 1 - target)
    return flags


def test_fixed_false_alarm_rule(spark):
    label, a, b, year = cases()
    df = frame(spark, label, a, b, year)
    out = cal.fixed_false_alarm(df, ["a", "b"], [0.1, 0.2], "row_id").collect()
    for target in (0.1, 0.2):
        want = reference_rule(label, [a, b], year, target)
        got = {r.row_id: r.flag for r in out if r.target == target}
        assert [got[i] for i in range(len(label))] == list(want)
        dry = want[label == 0].mean()
        assert abs(dry - target) < 0.03


def test_best_threshold_first_best_wins(spark):
    label, a, b, year = cases()
    df = frame(spark, label, a, b, year)
    best, tss = None, -1.0
    for t in np.unique(np.round(a[label == 1], 5)):
        s = (a >= t)[label == 1].mean() - (a >= t)[label == 0].mean()
        if s > tss + 1e-12:
            best, tss = t, s
    row = ver.best_threshold(df, "a", "label").first()
    assert abs(row.threshold - best) < 1e-9 and abs(row.tss - tss) < 1e-9
    folds = {(r.fold, r.window_name) for r in cal.best_tss_by_year(df, ["a", "b"]).collect()}
    assert len(folds) == 12


def test_episodes(spark):
    days = [("x", d) for d in ((6, 16), (6, 17), (6, 19), (8, 1))] + [("y", (6, 17))]
    df = spark.createDataFrame([(d, dt.date(2015, *md)) for d, md in days], "district string, day date")
    got = sorted((r.district, r.start.day, r.end.day) for r in cal.build_episodes(df).collect())
    assert got == [("x", 1, 1), ("x", 16, 19), ("y", 17, 17)]


def test_labels(spark):
    days = [dt.date(2015, 7, 1) + dt.timedelta(days=i) for i in range(20)]
    df = spark.createDataFrame([("d", d, float(i), float(100 - i)) for i, d in enumerate(days)], "district string, day date, w double, ante double")
    ev = spark.createDataFrame([("e", "d", dt.date(2015, 7, 8), dt.date(2015, 7, 10), "rain"), ("g", "d", dt.date(2015, 7, 19), dt.date(2015, 7, 19), "glacier")],
                               "event_id string, district string, start date, end date, kind string")
    out = cal.label_days(df, ev, ["w"], ["ante"]).collect()
    pos = [r for r in out if r.label == 1]
    assert len(pos) == 1 and pos[0].w == 9.0 and pos[0].ante == 93.0
    assert sorted(r.day.day for r in out if r.label == 0) == [1, 2, 3, 4, 14, 15]


def test_quantile_map(spark):
    xs, ys, lv = [0.0, 1.0, 1.0, 4.0], [0.0, 2.0, 3.0, 10.0], [0.1, 0.2, 0.3, 0.9]
    for mm in (-1.0, 0.5, 1.0, 2.0, 3.9):
        want = np.interp(np.interp(mm, xs, lv), lv, ys)
        col = cal.to_live_units(F.lit(mm), *[F.array(*[F.lit(x) for x in v]) for v in (xs, ys, lv)])
        assert abs(spark.range(1).select(col.alias("v")).first().v - want) < 1e-9
    top = cal.to_live_units(F.lit(8.0), *[F.array(*[F.lit(x) for x in v]) for v in (xs, ys, lv)])
    assert spark.range(1).select(top.alias("v")).first().v == 20.0


def test_bootstrap_no_gain_and_gain(spark):
    df = spark.range(400).select(F.lit(1).alias("label"), (F.col("id") % 2 == 0).alias("rule"), (F.col("id") % 2 == 1).alias("same"), (F.col("id") % 4 < 3).alias("better"))
    none = ver.pod_difference_interval(df, "same", "rule", "label", 400).first()
    gain = ver.pod_difference_interval(df, "better", "rule", "label", 400).first()
    assert none.low < 0 < none.high and gain.low > 0 and abs(gain.diff - 0.25) < 1e-9


def test_model_learns_and_groups_stay_whole(spark):
    label, a, b, year = cases(seed=7, signal=6.0)
    df = frame(spark, label, a, b, year)
    scored = ml.out_of_fold(sa.interleaved_folds(df, "year", 3), ["a", "b"], "linear")
    assert scored.count() == len(label)
    assert ver.roc_auc(scored, "prob", "label").first().auc > 0.9
    folds = sa.balanced_folds(df, "year", 3)
    assert folds.groupBy("year").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    split = sa.split_groups(df, "year", 3)
    assert split.groupBy("year").agg(F.count_distinct("held_out").alias("n")).filter("n > 1").count() == 0


def test_gate_and_inversions(spark):
    good = spark.createDataFrame([(0.5,)], "tss double")
    poor = spark.createDataFrame([(0.4,)], "tss double")
    assert cal.publish_gate(good, poor) and not cal.publish_gate(poor, good)
    pts = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 2.0)], "point_id int, watch double, critical double")
    assert [r.point_id for r in cal.inverted_thresholds(pts).collect()] == [2]
