"""Spatial joins as equi-joins on grid cells.

The lookup side (polygon sides, targets) is spread over the cells it can matter to, so every point
looks at its own cell only and is never repeated. Inside a cell a polygon is known by the sides that
touch the cell plus one bit, whether the cell's upper right corner is inside; the containment test
walks from the point to that corner and counts crossings, so its cost does not depend on how many
sides the polygon has elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewater.functions.geo import (
    KM_PER_DEGREE,
    crosses_above,
    crosses_right,
    crossing_fraction,
    haversine_km,
    polygon_edges,
    segment_km,
    segments_intersect,
)
from ridgewater.operators.scale import first_per_group, spread, spread_join, top_per_group
from ridgewater.session import stage

CLASSIFY_MAX_KM = 15.0
_MARGIN = 1e-9


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def segment_cells(
    segments: DataFrame, size: float, reach_km: float = 0.0, ends: tuple = ("ax", "ay", "bx", "by")
) -> DataFrame:
    """Repeat each segment for every cell it comes within ``reach_km`` of.

    Adds cell_row, cell_col and ``local`` (the segment touches the cell itself). The segment is cut
    by rows first, so a long diagonal takes cells along its course and not its whole bounding box.
    """
    ax, ay, bx, by = (F.col(c) for c in ends)
    d_lat = reach_km / KM_PER_DEGREE * 1.01 + _MARGIN
    rows = segments.withColumn(
        "cell_row", F.explode(_cells(F.least(ay, by) - d_lat, F.greatest(ay, by) + d_lat, size))
    )
    south, north = F.col("cell_row") * size, (F.col("cell_row") + 1) * size

    def span(pad: float) -> tuple[Column, Column]:
        """Longitudes the segment takes between the row's limits, widened by ``pad``."""
        dy = by - ay
        t1 = (south - pad - ay) / F.when(dy != 0, dy)
        t2 = (north + pad - ay) / F.when(dy != 0, dy)
        lo = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(t1, t2))), F.lit(0.0))
        hi = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.greatest(t1, t2))), F.lit(1.0))
        x1, x2 = ax + lo * (bx - ax), ax + hi * (bx - ax)
        return F.least(x1, x2), F.greatest(x1, x2)

    near_west, near_east = span(d_lat)
    own_west, own_east = span(_MARGIN)
    top_lat = F.least(F.lit(89.0), F.greatest(F.abs(south), F.abs(north)) + d_lat)
    d_lon = F.lit(d_lat) / F.cos(F.radians(top_lat))
    touches_row = (F.least(ay, by) - _MARGIN < north) & (F.greatest(ay, by) + _MARGIN >= south)
    out = rows.select(
        "*",
        F.explode(_cells(near_west - d_lon, near_east + d_lon, size)).alias("cell_col"),
        F.floor((own_west - _MARGIN) / size).alias("_first"),
        F.floor((own_east + _MARGIN) / size).alias("_last"),
        touches_row.alias("_row"),
    )
    local = F.col("_row") & F.col("cell_col").between(F.col("_first"), F.col("_last"))
    return out.withColumn("local", local).drop("_first", "_last", "_row")


def polygon_index(polygons: DataFrame, size: float, reach_km: float = 0.0) -> DataFrame:
    """Cell table of a polygon layer.

    Side rows carry ax..by and ``local``; inside rows (``corner`` = 1) say that a cell's upper right
    corner is in the polygon. Columns: cell_row, cell_col, polygon_id, local, corner, ax, ay, bx, by.
    """
    edges = polygon_edges(polygons)
    sides = segment_cells(edges, size, reach_km).select(
        "cell_row", "cell_col", "polygon_id", "local", F.lit(0).alias("corner"), "ax", "ay", "bx", "by"
    )
    # Corners along the top of each row: every side that straddles that latitude flips the corners to
    # its left, so a running count from the right gives the inside bit of each cell.
    straddles = edges.filter(F.col("ay") != F.col("by")).withColumn(
        "cell_row",
        F.explode(
            F.sequence(
                F.floor(F.least("ay", "by") / size) - 1, F.floor(F.greatest("ay", "by") / size)
            )
        ),
    )
    top = (F.col("cell_row") + 1) * F.lit(size)
    straddles = straddles.filter((F.least("ay", "by") <= top) & (F.greatest("ay", "by") > top))
    bounds = edges.groupBy("polygon_id").agg(F.floor(F.min(F.least("ax", "bx")) / size).alias("_west"))
    x_at = F.col("ax") + (top - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    last = F.floor(x_at / size)
    corners = (
        straddles.join(bounds, "polygon_id")
        .withColumn("cell_col", F.explode(F.sequence(F.col("_west") - 1, last + 1)))
        .withColumn(
            "_cross",
            crosses_right(
                (F.col("cell_col") + 1) * F.lit(size), top, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")
            ),
        )
        .groupBy("cell_row", "cell_col", "polygon_id")
        .agg((F.sum("_cross") % 2).cast("int").alias("corner"))
        .filter("corner = 1")
    )
    nothing = F.lit(None).cast("double")
    inside = corners.select(
        "cell_row",
        "cell_col",
        "polygon_id",
        F.lit(True).alias("local"),
        "corner",
        *[nothing.alias(c) for c in ("ax", "ay", "bx", "by")],
    )
    return sides.unionByName(inside)


def _crossings(px: Column, py: Column, size: float) -> Column:
    """Sides crossed on the way from a point to its cell's upper right corner (0, 1 or 2)."""
    corner_x = (F.col("cell_col") + 1) * F.lit(size)
    corner_y = (F.col("cell_row") + 1) * F.lit(size)
    sides = (F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    along = crosses_right(px, py, *sides) - crosses_right(corner_x, py, *sides)
    up = crosses_above(corner_x, py, *sides) - crosses_above(corner_x, corner_y, *sides)
    return F.when(F.col("local") & F.col("ax").isNotNull(), F.abs(along) + F.abs(up)).otherwise(0)


def _matches(points: DataFrame, polygons: DataFrame, size: float, reach_km: float, measure: bool) -> DataFrame:
    """One row per point and nearby polygon: inside (bool) and, when measured, km to its outline."""
    index = stage(polygon_index(polygons, size, reach_km), "polygon-index")
    return _flips(points, index, size, measure).withColumn("inside", F.col("_flips") % 2 == 1).drop("_flips")


def _flips(points: DataFrame, index: DataFrame, size: float, measure: bool = False) -> DataFrame:
    """point_id, polygon_id, _flips (odd: inside) and, when measured, km, from the cell table of a layer."""
    keyed = points.select(
        "point_id",
        "lat",
        "lon",
        F.floor(F.col("lat") / size).alias("cell_row"),
        F.floor(F.col("lon") / size).alias("cell_col"),
    )
    joined = spread_join(keyed, index, ["cell_row", "cell_col"], row_id="point_id")
    flips = _crossings(F.col("lon"), F.col("lat"), size) + F.col("corner")
    km = segment_km(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    aggs = [F.sum(flips).alias("_flips")] + ([F.min(km).alias("km")] if measure else [])
    return joined.groupBy("point_id", "polygon_id").agg(*aggs)


def containing_polygons(points: DataFrame, polygons: DataFrame, size: float = 0.15) -> DataFrame:
    """Every (point_id, polygon_id) where the polygon contains the point; holes are respected.

    A point exactly on an outline is a tie: lower and left outlines count as inside.
    """
    hits = _matches(points, polygons, size, 0.0, measure=False)
    return hits.filter("inside").select("point_id", "polygon_id")


def point_in_polygon(points: DataFrame, polygons: DataFrame, size: float = 0.15) -> DataFrame:
    """Left outer: each point with the lowest-numbered polygon that contains it, or null."""
    first = containing_polygons(points, polygons, size).groupBy("point_id").agg(F.min("polygon_id").alias("polygon_id"))
    return points.join(first, "point_id", "left")


def covers(points: DataFrame, polygons: DataFrame, size: float = 0.15) -> DataFrame:
    """Like containing_polygons with the outline counted as inside."""
    hits = _matches(points, polygons, size, 0.001, measure=True)
    return hits.filter(F.col("inside") | (F.col("km") <= 1e-12)).select("point_id", "polygon_id")


def classify(
    points: DataFrame, polygons: DataFrame, max_km: float = CLASSIFY_MAX_KM, keep_far: bool = False
) -> DataFrame:
    """Class of the containing polygon, else of the nearest polygon within ``max_km``.

    One row per point: point_id, polygon_id, hazard_class, exact, km. Points with nothing in reach
    have a null class; with ``keep_far`` they still get the distance to the nearest polygon, found by
    widening the reach until every point has one.
    """
    reach, found, pending = max_km, None, points.select("point_id", "lat", "lon")
    while True:
        size = max(reach / KM_PER_DEGREE, 0.01)
        hits = _matches(pending, polygons, size, reach, measure=True)
        near = hits.filter(F.col("inside") | (F.col("km") <= reach))
        best = (
            near.groupBy("point_id")
            .agg(
                F.min(
                    F.struct(
                        (~F.col("inside")).alias("outside"),
                        F.when(F.col("inside"), 0.0).otherwise(F.col("km")).alias("km"),
                        "polygon_id",
                    )
                ).alias("b")
            )
            .select("point_id", "b.polygon_id", (~F.col("b.outside")).alias("exact"), "b.km")
        )
        if reach == max_km and not keep_far:
            found = best
            break
        best = stage(best, "classify-round")
        found = best if found is None else found.unionByName(best)
        pending = stage(pending.join(best.select("point_id"), "point_id", "left_anti"), "classify-pending")
        if reach > 20_100 or pending.isEmpty():
            break
        reach *= 4.0
    classes = polygons.select("polygon_id", "hazard_class")
    out = points.select("point_id").join(found, "point_id", "left").join(classes, "polygon_id", "left")
    known = F.col("km") <= max_km
    return out.select(
        "point_id",
        F.when(known, F.col("polygon_id")).alias("polygon_id"),
        F.when(known, F.col("hazard_class")).alias("hazard_class"),
        F.coalesce(F.col("exact"), F.lit(False)).alias("exact"),
        "km",
    )


def _spread_targets(targets: DataFrame, radius_km: float) -> tuple[DataFrame, float]:
    """Targets repeated over every cell a point within ``radius_km`` of them can be in."""
    size = radius_km / KM_PER_DEGREE * 1.01
    top = F.least(F.lit(89.0), F.abs(F.col("t_lat")) + size)
    d_lon = F.lit(size) / F.cos(F.radians(top))
    spread = targets.withColumn(
        "cell_row", F.explode(_cells(F.col("t_lat") - size, F.col("t_lat") + size, size))
    ).withColumn("cell_col", F.explode(_cells(F.col("t_lon") - d_lon, F.col("t_lon") + d_lon, size)))
    return spread, size


def within_radius(points: DataFrame, targets: DataFrame, radius_km: float) -> DataFrame:
    """Every pair at most ``radius_km`` apart: the points' columns, target_id, km.

    ``points`` needs point_id, lat, lon; ``targets`` needs target_id, lat, lon.
    """
    renamed = targets.withColumnsRenamed({"lat": "t_lat", "lon": "t_lon"})
    spread, size = _spread_targets(renamed, radius_km)
    keyed = points.withColumn("cell_row", F.floor(F.col("lat") / size)).withColumn(
        "cell_col", F.floor(F.col("lon") / size)
    )
    pairs = spread_join(keyed, spread, ["cell_row", "cell_col"], row_id="point_id")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    return pairs.withColumn("km", km).filter(F.col("km") <= radius_km).drop("cell_row", "cell_col", "t_lat", "t_lon")


def within_radius_by_place(points: DataFrame, targets: DataFrame, radius_km: float, digits: int) -> DataFrame:
    """``within_radius`` for layers whose positions repeat: point_id, target_id, km rounded to ``digits`` places.

    A distance is worked out and rounded once for each pair of places, however many points and targets share them.
    """
    at, near = spread(_spots(points)), spread(_spots(targets).withColumnRenamed("point_id", "target_id"))
    km = F.round("km", digits).alias("km")
    places = stage(within_radius(at, near, radius_km).select(F.col("point_id").alias("_at"), F.col("target_id").alias("_near"), km), "places")
    here = points.join(at.withColumnRenamed("point_id", "_at"), ["lat", "lon"]).select("_at", "point_id")
    there = targets.join(near.withColumnRenamed("target_id", "_near"), ["lat", "lon"]).select("_near", "target_id")
    return places.join(there, "_near").join(here, "_at").select("point_id", "target_id", "km")


def nearest_within(points: DataFrame, targets: DataFrame, max_km: float) -> DataFrame:
    """Left outer: each point with its nearest target inside ``max_km`` (ties to the lower id), or null."""
    best = nearest_k(points.select("point_id", "lat", "lon"), targets.select("target_id", "lat", "lon"), 1, max_km)
    return points.join(best.select("point_id", "target_id", "km"), "point_id", "left")


def _distinct_places(targets: DataFrame, k: int) -> DataFrame:
    """Targets with at most ``k`` per exact position: only the k lowest ids there can rank in a top k."""
    return top_per_group(targets, ["lat", "lon"], [F.col("target_id")], k, "_copy").drop("_copy")


def _spots(points: DataFrame) -> DataFrame:
    """The different positions of ``points``, written with a number of their own as point_id."""
    return stage(points.select("lat", "lon").distinct().withColumn("point_id", F.monotonically_increasing_id()), "spots")


def _fullest_cell(targets: DataFrame, radius_km: float) -> int:
    size = radius_km / KM_PER_DEGREE
    return (
        targets.groupBy(F.floor(F.col("lat") / size), F.floor(F.col("lon") / size)).count().agg(F.max("count")).first()[0]
        or 0
    )


def nearest_k(
    points: DataFrame, targets: DataFrame, k: int, max_km: float | None = None, start_km: float = 16.0
) -> DataFrame:
    """The k nearest targets of every point: point_id, target_id, km, rank. Exact, with no pair cap.

    The search starts at a radius fitted to the fullest part of the target layer, settles the places
    that already have k targets inside it, and doubles it for the rest. Points at one place share its
    search; a point without a position has no targets.
    """
    known = points.select("point_id", "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL")
    spots = _spots(known)
    found = stage(_nearest_k(spots, targets, k, max_km, start_km).join(spots, "point_id").drop("point_id"), "nearest")
    return known.join(found, ["lat", "lon"]).select("point_id", "target_id", "km", "rank")


def _nearest_k(points: DataFrame, targets: DataFrame, k: int, max_km: float | None, start_km: float) -> DataFrame:
    """``nearest_k`` for points at different places."""
    spark = points.sparkSession
    places = stage(_distinct_places(targets.select("target_id", "lat", "lon"), k), "targets")
    limit_km = max_km if max_km is not None else 20_100.0
    radius = min(start_km, limit_km)
    fullest = _fullest_cell(places, radius)
    while radius > 0.05 and fullest > 16 * k:
        radius /= 2.0
        fullest = _fullest_cell(places, radius)
    while radius * 2.0 < limit_km and fullest < 2 * k:
        radius *= 2.0
        fullest = _fullest_cell(places, radius)
    pending, done = points, None
    while True:
        pairs = within_radius(pending, places, radius).select("point_id", "target_id", "km")
        ranked = top_per_group(pairs, ["point_id"], [F.col("km"), F.col("target_id")], k)
        if radius >= limit_km:
            last = ranked
            break
        ranked = stage(ranked, "nearest-round")
        settled = ranked.groupBy("point_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
        settled = settled.select("point_id")
        part = ranked.join(settled, "point_id", "left_semi")
        done = part if done is None else done.unionByName(part)
        pending = stage(pending.join(settled, "point_id", "left_anti"), "nearest-pending")
        if pending.isEmpty():
            last = spark.createDataFrame([], ranked.schema)
            break
        radius = min(radius * 2.0, limit_km)
    return last if done is None else done.unionByName(last)


def nearest_on_grid(points: DataFrame, grid: DataFrame, max_degrees: float = 0.3, step: float = 0.25) -> DataFrame:
    """Left outer: nearest point of a regular-ish grid, by degrees with longitude scaled by cos(lat).

    ``grid`` needs target_id, lat, lon. Beyond ``max_degrees`` the match is null. The search starts at a reach fitted
    to the fullest part of the grid, at most ``step``, and doubles it for the places that have found nothing.
    """
    known = points.filter("lat IS NOT NULL AND lon IS NOT NULL")
    pending = _spots(known)
    places = stage(_distinct_places(grid.select("target_id", "lat", "lon"), 1), "targets")
    reach, done = min(step, max_degrees), None
    while reach > 0.0005 and _fullest_cell(places, reach * KM_PER_DEGREE) > 16:
        reach /= 2.0
    while True:
        found = stage(_nearest_by_degrees(pending, places, reach), "nearest-round")
        done = found if done is None else done.unionByName(found)
        if reach >= max_degrees:
            break
        pending = stage(pending.join(found.select("point_id"), "point_id", "left_anti"), "nearest-pending")
        if pending.isEmpty():
            break
        reach = min(reach * 2.0, max_degrees)
    return points.join(done.select("lat", "lon", "target_id", "degrees"), ["lat", "lon"], "left").select(
        *points.columns, "target_id", "degrees"
    )


def _nearest_by_degrees(points: DataFrame, grid: DataFrame, reach: float) -> DataFrame:
    """Points with a grid point within ``reach`` degrees: point_id, lat, lon, target_id, degrees."""
    size = reach * (1 + 1e-9)
    renamed = grid.select("target_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    top = F.least(F.lit(89.0), F.abs(F.col("t_lat")) + size)
    d_lon = F.lit(size) / F.cos(F.radians(top))
    spread = renamed.withColumn(
        "cell_row", F.explode(_cells(F.col("t_lat") - size, F.col("t_lat") + size, size))
    ).withColumn("cell_col", F.explode(_cells(F.col("t_lon") - d_lon, F.col("t_lon") + d_lon, size)))
    keyed = points.select(
        "point_id", "lat", "lon", F.floor(F.col("lat") / size).alias("cell_row"), F.floor(F.col("lon") / size).alias("cell_col")
    )
    pairs = spread_join(keyed, spread, ["cell_row", "cell_col"], row_id="point_id")
    dx = (F.col("lon") - F.col("t_lon")) * F.cos(F.radians("lat"))
    dy = F.col("lat") - F.col("t_lat")
    return first_per_group(
        pairs.withColumn("degrees", F.sqrt(dx * dx + dy * dy)).filter(F.col("degrees") <= reach),
        ["point_id"],
        [F.col("degrees"), F.col("target_id")],
    ).select("point_id", "lat", "lon", "target_id", "degrees")


def join_on_position(left: DataFrame, right: DataFrame, places: int = 5) -> DataFrame:
    """Equi-join of two tables with lat/lon on coordinates rounded to ``places`` decimals."""
    from ridgewater.functions.geo import coordinate_key

    lk, rk = coordinate_key(F.col("lat"), F.col("lon"), places), coordinate_key(F.col("lat"), F.col("lon"), places)
    keyed_left = left.withColumn("lat_key", lk[0]).withColumn("lon_key", lk[1])
    keyed_right = right.withColumn("lat_key", rk[0]).withColumn("lon_key", rk[1]).drop("lat", "lon")
    return keyed_left.join(keyed_right, ["lat_key", "lon_key"])


def _touched_cells(segments: DataFrame, size: float, ends: tuple = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Repeat each segment for the cells it touches: what ``segment_cells`` marks as local, without a reach."""
    ax, ay, bx, by = (F.col(c) for c in ends)
    steep = segments.withColumn("_slope", (bx - ax) / F.when(by != ay, by - ay))
    rows = steep.withColumn("cell_row", F.explode(_cells(F.least(ay, by) - _MARGIN, F.greatest(ay, by) + _MARGIN, size)))

    def at(limit: Column) -> Column:
        """Longitude at the row's limit; at an end where the segment does not get that far."""
        y = F.greatest(F.least(ay, by), F.least(F.greatest(ay, by), limit))
        return F.when(y == ay, ax).when(y == by, bx).otherwise(ax + (y - ay) * F.col("_slope"))

    low, high = at(F.col("cell_row") * size - _MARGIN), at((F.col("cell_row") + 1) * size + _MARGIN)
    placed = rows.select("*", F.when(ay == by, ax).otherwise(low).alias("_x1"), F.when(ay == by, bx).otherwise(high).alias("_x2"))
    cols = _cells(F.least("_x1", "_x2") - _MARGIN, F.greatest("_x1", "_x2") + _MARGIN, size)
    return placed.withColumn("cell_col", F.explode(cols)).drop("_slope", "_x1", "_x2")


def segment_hits(segments: DataFrame, polygons: DataFrame, size: float = 0.15, touching: bool = True) -> DataFrame:
    """``segments_in_polygons`` with a pair repeated for every side met, for callers that aggregate anyway.

    Only sides are looked up along a segment; whether it starts inside is asked once for each position starts are at.
    """
    index = stage(polygon_index(polygons, size).filter("local").drop("local"), "polygon-index")
    ends = ("x1", "y1", "x2", "y2")
    whole = stage(spread(segments.select("segment_id", *ends), "segment_id"), "segments")
    pieces = _touched_cells(whole, size)
    joined = spread_join(pieces, index.filter("ax IS NOT NULL").drop("corner"), ["cell_row", "cell_col"], row_id="segment_id")
    meets = segments_intersect(
        (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), touching
    )
    starts = _spots(whole.select(F.col("x1").alias("lon"), F.col("y1").alias("lat")).filter("lat IS NOT NULL AND lon IS NOT NULL"))
    within = _flips(starts, index.withColumn("local", F.lit(True)), size).filter(F.col("_flips") % 2 == 1)
    within = stage(within.join(starts, "point_id").select("polygon_id", F.col("lon").alias("x1"), F.col("lat").alias("y1")), "starts")
    inside = spread_join(whole, within, ["x1", "y1"], row_id="segment_id")
    return joined.filter(meets).select("segment_id", "polygon_id").unionByName(inside.select("segment_id", "polygon_id"))


def segments_in_polygons(segments: DataFrame, polygons: DataFrame, size: float = 0.15, touching: bool = True) -> DataFrame:
    """Every (segment_id, polygon_id) that share a point. ``segments``: segment_id, x1, y1, x2, y2.

    Without ``touching`` a segment has to start inside or to cross a side; meeting a corner exactly is no crossing.
    """
    return segment_hits(segments, polygons, size, touching).distinct()


def flooded_ratio(segments: DataFrame, polygons: DataFrame, size: float = 0.15) -> DataFrame:
    """Share of each segment's length inside each polygon it meets: segment_id, polygon_id, ratio.

    Crossing positions are listed once per segment and side; entries and exits alternate along the
    segment, so their signed sum is the inside share.
    """
    from pyspark.sql import Window

    index = stage(polygon_index(polygons, size), "polygon-index")
    ends = ("x1", "y1", "x2", "y2")
    pieces = segment_cells(spread(segments.select("segment_id", *ends), "segment_id"), size, ends=ends).filter("local").drop("local")
    joined = spread_join(pieces, index.filter("local"), ["cell_row", "cell_col"], row_id="segment_id")
    a, b = (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))
    c, d = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    start_here = (F.floor(F.col("y1") / size) == F.col("cell_row")) & (F.floor(F.col("x1") / size) == F.col("cell_col"))
    started = (
        joined.filter(start_here)
        .groupBy("segment_id", "polygon_id")
        .agg((F.sum(_crossings(F.col("x1"), F.col("y1"), size) + F.col("corner")) % 2).alias("_inside"))
        .filter("_inside = 1")
    )
    cuts = (
        joined.filter(F.col("ax").isNotNull() & segments_intersect(a, b, c, d))
        .select("segment_id", "polygon_id", "ax", "ay", "bx", "by", crossing_fraction(a, b, c, d).alias("_t"))
        .filter(F.col("_t").isNotNull())
        .dropDuplicates(["segment_id", "polygon_id", "ax", "ay", "bx", "by"])
    )
    both = cuts.select("segment_id", "polygon_id", "_t").join(started, ["segment_id", "polygon_id"], "full")
    order = Window.partitionBy("segment_id", "polygon_id").orderBy("_t")
    inside_before = (F.row_number().over(order) - 1 + F.coalesce(F.col("_inside"), F.lit(0))) % 2
    signed = F.when(F.col("_t").isNull(), 0.0).otherwise(
        F.when(inside_before == 1, F.col("_t")).otherwise(-F.col("_t"))
    )
    return (
        both.withColumn("_signed", signed)
        .groupBy("segment_id", "polygon_id")
        .agg(
            F.sum("_signed").alias("_sum"),
            F.count("_t").alias("_n"),
            F.coalesce(F.max("_inside"), F.lit(0)).alias("_inside"),
        )
        .select(
            "segment_id",
            "polygon_id",
            F.greatest(
                F.lit(0.0),
                F.least(
                    F.lit(1.0), F.col("_sum") + F.when((F.col("_n") + F.col("_inside")) % 2 == 1, 1.0).otherwise(0.0)
                ),
            ).alias("ratio"),
        )
    )


def layer_bounds(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")
    )


def grid_nodes_in(polygons: DataFrame, step: float = 0.25) -> DataFrame:
    """Every multiple of ``step`` degrees inside a polygon: polygon_id, lat, lon."""
    edges = polygon_edges(polygons)
    box = edges.groupBy("polygon_id").agg(
        F.min(F.least("ax", "bx")).alias("w"), F.max(F.greatest("ax", "bx")).alias("e"),
        F.min(F.least("ay", "by")).alias("s"), F.max(F.greatest("ay", "by")).alias("n"),
    )
    nodes = (
        box.withColumn("_row", F.explode(F.sequence(F.ceil(F.col("s") / step), F.floor(F.col("n") / step))))
        .withColumn("_col", F.explode(F.sequence(F.ceil(F.col("w") / step), F.floor(F.col("e") / step))))
        .select(F.xxhash64("_row", "_col").alias("point_id"), (F.col("_row") * step).alias("lat"),
                (F.col("_col") * step).alias("lon"))
        .dropDuplicates(["point_id"])
    )
    return containing_polygons(nodes, polygons).join(nodes, "point_id").select("polygon_id", "lat", "lon")


def distance_clusters(points: DataFrame, degrees: float = 0.03) -> DataFrame:
    """Single-link clusters: point_id, cluster (its smallest point), joined where points lie within ``degrees``.

    Cells are so small that all points of one cell are within reach, so a crowded cell costs one link per point;
    only cells up to two away are compared, place by place, and of those pairs one link per pair of cells goes on.
    """
    from ridgewater.operators.graph import components

    side = degrees / 2**0.5 * (1 - 1e-9)
    spots = points.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.min("point_id").alias("point_id"))
    own = spots.select(
        "point_id", "lat", "lon", F.floor(F.col("lat") / side).alias("cell_row"), F.floor(F.col("lon") / side).alias("cell_col")
    )
    own = stage(own, "cells")
    first = own.groupBy("cell_row", "cell_col").agg(F.min("point_id").alias("a"))
    inner = own.join(first, ["cell_row", "cell_col"]).select("a", F.col("point_id").alias("b")).filter("a != b")
    steps = [(r, c) for r in range(-2, 3) for c in range(-2, 3) if (r, c) > (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))
    moved = own.select(
        F.col("point_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"),
        F.col("cell_row").alias("from_row"), F.col("cell_col").alias("from_col"), step.alias("s"),
    ).withColumn("cell_row", F.col("from_row") + F.col("s.r")).withColumn("cell_col", F.col("from_col") + F.col("s.c"))
    met = spread_join(spread(moved.drop("s"), "a"), own, ["cell_row", "cell_col"], row_id="a")
    near = met.filter(F.hypot(F.col("lat") - F.col("a_lat"), F.col("lon") - F.col("a_lon")) <= degrees)
    across = near.groupBy("from_row", "from_col", "cell_row", "cell_col").agg(F.min(F.struct("a", F.col("point_id").alias("b"))).alias("link"))
    links = inner.unionByName(across.select("link.a", "link.b"))
    found = components(links).select(F.col("node").alias("point_id"), F.col("component").alias("cluster"))
    placed = own.join(found, "point_id", "left").select("lat", "lon", F.coalesce("cluster", "point_id").alias("cluster"))
    return points.join(placed, ["lat", "lon"], "left").select("point_id", F.coalesce("cluster", "point_id").alias("cluster"))
