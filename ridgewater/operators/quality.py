"""Checks on inputs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewater.functions.text import accuracy_km
from ridgewater.operators.rain import plausible
from ridgewater.operators.spatial import point_in_polygon

# Triggers that count as rain, and the box of the catalogue search.
RAIN_TRIGGERS = [
    "rain", "downpour", "monsoon", "continuous_rain", "continuous rain", "tropical_cyclone", "tropical cyclone",
    "tropical_storm", "flooding", "flood",
]
BOX = (28.6, 31.6, 77.4, 81.2)
MAX_ACCURACY_KM = 25


def in_box(lat: Column, lon: Column, box: tuple = BOX) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def select_catalogue(events: DataFrame, districts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): events in a district, located within 25 km and triggered by rain, with a count per reason.

    ``events``: event_id, lat, lon, accuracy, trigger. ``districts``: polygon_id, name, rings.
    """
    boxed = events.filter(in_box(F.col("lat"), F.col("lon"))).withColumn("point_id", F.col("event_id"))
    placed = point_in_polygon(boxed, districts).join(districts.select("polygon_id", F.col("name").alias("district")), "polygon_id", "left")
    km = accuracy_km(F.col("accuracy"))
    trigger = F.lower(F.trim(F.coalesce("trigger", F.lit(""))))
    reason = (
        F.when(F.col("polygon_id").isNull(), "outside")
        .when(km.isNull() | (km > MAX_ACCURACY_KM), "dropped_location_too_coarse")
        .when(~trigger.isin(*RAIN_TRIGGERS), F.concat(F.lit("dropped_trigger_"), F.when(trigger == "", "blank").otherwise(trigger)))
    )
    judged = placed.withColumn("accuracy_km", km).withColumn("drop_reason", reason).drop("point_id")
    counts = judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return judged.filter("drop_reason IS NULL").drop("drop_reason"), counts


def accept_batches(hourly: DataFrame, expected: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """All-or-nothing check of relayed batches: (accepted rows, one verdict row per batch).

    ``hourly``: batch_id, location, latitude, longitude, ts, mm. ``expected``: location, lat, lon. A batch is
    taken when it has every location once within 0.2 degrees, no series longer than ``longest`` and only
    plausible values (null allowed).
    """
    n = expected.agg(F.count(F.lit(1)).alias("_expected"))
    per_location = hourly.join(expected, "location", "left").groupBy("batch_id", "location").agg(
        F.count(F.lit(1)).alias("_hours"),
        F.bool_and(F.col("mm").isNull() | plausible(F.col("mm"))).alias("_plausible"),
        F.bool_and(
            F.coalesce((F.abs(F.col("latitude") - F.col("lat")) <= 0.2) & (F.abs(F.col("longitude") - F.col("lon")) <= 0.2), F.lit(False))
        ).alias("_placed"),
    )
    verdict = (
        per_location.groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("n_locations"),
            F.bool_and("_plausible").alias("plausible"),
            F.bool_and("_placed").alias("in_order"),
            (F.max("_hours") <= longest).alias("not_too_long"),
        )
        .join(F.broadcast(n), F.lit(True))  # one row
    )
    verdict = verdict.withColumn(
        "accepted", F.col("plausible") & F.col("in_order") & F.col("not_too_long") & (F.col("n_locations") == F.col("_expected"))
    ).drop("_expected")
    return hourly.join(verdict.filter("accepted").select("batch_id"), "batch_id", "left_semi"), verdict


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str], tolerance: float = 0.051, info_only: tuple = ()) -> DataFrame:
    """Field-by-field differences of two results: key, field, left_value, right_value, info_only.

    Numbers may differ by ``tolerance``; missing on both sides is equal; a missing row counts for every field.
    """
    l = left.select(key, *[F.col(f).alias(f"l_{f}") for f in fields])
    r = right.select(key, *[F.col(f).alias(f"r_{f}") for f in fields])
    numeric = {n for n, t in left.select(*fields).dtypes if t in ("double", "float", "int", "bigint", "smallint") or t.startswith("decimal")}
    rows = []
    for f in fields:
        a, b = F.col(f"l_{f}"), F.col(f"r_{f}")
        equal = a.eqNullSafe(b)
        if f in numeric:
            equal = equal | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
        rows.append(F.struct(F.lit(f).alias("field"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"),
                             equal.alias("equal"), F.lit(f in info_only).alias("info_only")))
    both = l.join(r, key, "full")
    return both.select(key, F.explode(F.array(*rows)).alias("d")).filter("NOT d.equal").select(
        key, "d.field", "d.left_value", "d.right_value", "d.info_only"
    )


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """Row count per layer."""
    out = None
    for name, df in layers.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def keep_large(polygons: DataFrame, least_m2: float = 100.0) -> DataFrame:
    """Polygons of at least ``least_m2`` with a usable outline."""
    from ridgewater.functions.geo import polygon_measures

    usable = polygons.filter(F.size("rings") > 0).filter(F.forall("rings", lambda r: F.size(r) >= 3))
    big = polygon_measures(usable).filter(F.col("area_m2") >= least_m2).select("polygon_id")
    return usable.join(big, "polygon_id", "left_semi")
