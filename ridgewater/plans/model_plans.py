"""Registered queries on models and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgewater.operators import calibrate as cal
from ridgewater.operators import models as ml
from ridgewater.operators import sampling as sa
from ridgewater.operators import spatial
from ridgewater.operators import verify as ver
from ridgewater.operators.raster import sample
from ridgewater.plans import views as v
from ridgewater.plans.raster_plans import _IDX, _indexed
from ridgewater.session import stage

_BOX = (77.5, 28.65, 81.1, 31.5)


def _cases(spark, sf):
    """Cases with a few numeric inputs; the label leans on two of them so that there is something to learn."""
    c = v.case_days(spark, sf)
    lean = F.col("value") / 500000.0 + F.col("value2") / 2000.0 + F.pmod(F.xxhash64("case_id"), F.lit(1000)) / 1000.0
    out = c.withColumn("label", (lean > 1.6).cast("int")).withColumn("value3", F.dayofyear("day").cast("double"))
    return stage(out.withColumn("row_id", F.col("case_id")), "cases")


def model_trees_grouped(spark, sf):
    """Boosted trees judged with whole districts held out."""
    out = ml.grouped_report(_cases(spark, sf), ["value", "value2", "value3"], "district", "trees", 3, rounds=5, depth=3)
    return out


def model_importance(spark, sf):
    cases = _cases(spark, sf)
    features = ["value", "value2", "value3"]
    return ml.importance_shares(ml.trees(features, rounds=5, depth=3).fit(cases), features)


def model_comparison(spark, sf):
    """The rule against a linear model, both leaving one year out."""
    cases = _cases(spark, sf)
    table, features = ml.feature_table(cases, ["value", "value2"], list(range(13)))
    linear = stage(ml.leave_one_year_out(table, features, "linear", "row_id", inner=2), "linear")
    rule = cal.fixed_false_alarm(cases, ["value", "value2"], [0.10, 0.20], "row_id")
    rule = rule.groupBy("row_id", "label").agg(
        F.max("score").alias("prob"), F.max(F.when(F.col("target") == 0.10, F.col("flag"))).alias("flag_critical")
    )
    return ml.compare({"rule": stage(rule, "rule"), "linear_all": linear}, "rule")


def model_stability(spark, sf):
    return ml.split_stability(_cases(spark, sf), ["value", "value2"], "district", "linear", 3)


def model_ablation(spark, sf):
    return ml.ablation(_cases(spark, sf), {"both": ["value", "value2"], "first": ["value"], "day": ["value3"]}, "district", "linear", 3)


def bootstrap_ci(spark, sf):
    c = v.case_days(spark, sf).withColumn("m", F.col("value") >= 250000.0).withColumn("r", F.col("value2") >= 500.0)
    return ver.pod_difference_interval(c, "m", "r", "label", 500)


def fold_assignment(spark, sf):
    """Size-balanced folds of districts: rows and districts per fold."""
    c = v.case_days(spark, sf)
    out = sa.balanced_folds(c, "district", 5)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("district").alias("n_districts"))


def year_folds(spark, sf):
    out = sa.interleaved_folds(v.case_days(spark, sf), "year", 3)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("year").alias("n_years"))


def background_points(spark, sf):
    pts = v.points(spark, sf)
    events = v.shelters(spark, sf).select(F.col("target_id").alias("event_id"), "lat", "lon")
    n = pts.count()
    out = sa.background_points(events, v.polygons(spark, sf), _BOX, n, 20 * n, settlements=pts.select(F.col("point_id").alias("target_id"), "lat", "lon"))
    return out


def polygon_samples(spark, sf):
    """At most 250 grid points inside each polygon."""
    out = sa.points_in_polygons(v.polygons(spark, sf), 0.01)
    return out.groupBy("polygon_id").agg(F.count(F.lit(1)).alias("n"))


def training_table(spark, sf):
    """Points with class, index and terrain bands; rows without an index are dropped."""
    classes = spatial.classify(v.points(spark, sf), v.polygons(spark, sf))
    pts = v.points(spark, sf).join(classes.select("point_id", "hazard_class"), "point_id")
    out = sa.training_table(pts, _indexed(spark, sf), (28.65, 77.5, 0.0357), ["slope", "twi", "ffpi"], ["ffpi", "hazard_class"])
    return out.groupBy("hazard_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ffpi"), 6).alias("ffpi"))


def event_validation(spark, sf):
    """Index at points in polygons against points outside, per accuracy cut."""
    pts = sample(v.points(spark, sf), _indexed(spark, sf), 28.65, 77.5, 0.0357, ["ffpi"])
    inside = spatial.containing_polygons(v.points(spark, sf), v.polygons(spark, sf)).select("point_id").distinct()
    marked = stage(pts.join(inside.withColumn("hit", F.lit(1)), "point_id", "left"), "marked")
    acc = F.element_at(F.array(*[F.lit(a) for a in ("1km", "5km", "10km", "25km", "50km")]), (F.col("point_id") % 5 + 1).cast("int"))
    events = marked.filter("hit = 1").withColumn("accuracy", acc)
    out = ml.event_validation(events, {"uniform": marked.filter("hit IS NULL")}, "ffpi", ["1km", "10km", "50km"])
    return out.select("cut", "background", "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in ("auc", "p_value", "median_event", "median_background")])


def stratified_sample(spark, sf):
    """One case per district and the rest by hash, 50 in all: which districts are there."""
    out = cal.stratified_sample(v.case_days(spark, sf), "district", "case_id", 50)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("district").alias("n_districts"))


_GRID = "floor((lat-28.65e0)/0.0357e0)"

QUERIES = {
    "model_trees_grouped": (model_trees_grouped, None),
    "model_importance": (model_importance, None),
    "model_comparison": (model_comparison, None),
    "model_stability": (model_stability, None),
    "model_ablation": (model_ablation, None),
    "bootstrap_ci": (bootstrap_ci, None),
    "fold_assignment": (
        fold_assignment,
        v.sql(
            "case_day",
            """SELECT fold, sum(n)::BIGINT AS n, count(*) AS n_districts FROM (SELECT n,
            (CASE WHEN (i // 5) % 2 = 1 THEN 4 - i % 5 ELSE i % 5 END)::INT AS fold FROM (SELECT n, row_number() OVER (ORDER BY n DESC, district) - 1 AS i
            FROM (SELECT district, count(*) AS n FROM case_day GROUP BY 1))) GROUP BY 1""",
        ),
    ),
    "year_folds": (
        year_folds,
        v.sql(
            "case_day",
            """SELECT fold, count(*) AS n, count(DISTINCT year) AS n_years FROM (SELECT year, ((dense_rank() OVER (ORDER BY year)-1) % 3)::INT AS fold FROM case_day) GROUP BY 1""",
        ),
    ),
    "background_points": (background_points, None),
    "polygon_samples": (
        polygon_samples,
        v.sql(
            "side",
            """SELECT polygon_id, least(250, count(*)) AS n FROM (SELECT polygon_id, lat, lon FROM g, side WHERE (y1 > lat) <> (y2 > lat)
            AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 GROUP BY 1,2,3 HAVING count(*) % 2 = 1) GROUP BY 1""",
            g="""SELECT r*0.01e0 AS lat, c*0.01e0 AS lon FROM (SELECT unnest(generate_series(2860, 3120)) AS r) CROSS JOIN (SELECT unnest(generate_series(7740, 8110)) AS c)""",
        ),
    ),
    "training_table": (
        training_table,
        v.sql(
            "classified pt cell",
            f"""SELECT hazard_class, count(*) AS n, round(avg(ffpi), 6) AS ffpi FROM pt JOIN classified USING (point_id)
            JOIN idx ON idx.row = {_GRID} AND idx.col = floor((lon-77.5e0)/0.0357e0) WHERE ffpi IS NOT NULL AND hazard_class IS NOT NULL GROUP BY 1""",
            idx=_IDX,
        ),
    ),
    "event_validation": (event_validation, None),
    "stratified_sample": (
        stratified_sample,
        v.sql("case_day", "SELECT least(50, count(*)) AS n, count(DISTINCT district) AS n_districts FROM case_day"),
    ),
}
