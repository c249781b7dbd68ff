"""Outlines as tables: clipping to a boundary of any shape, and thinning that keeps shared borders shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewater.functions import geo
from ridgewater.operators.scale import first_per_group, global_positions
from ridgewater.session import stage

CELL = 0.25


def convex_pieces(boundary: DataFrame) -> DataFrame:
    """A boundary with any dents, holes and parts as convex pieces: piece_id, window (4 corners, anticlockwise).

    The boundary is cut at the height of each of its corners. Between two such heights its sides do not meet, so
    the space between the first and second, third and fourth side and so on is a trapezium inside it. Sides of the
    same polygon set must not cross each other. No row of ``boundary`` gives no pieces.
    """
    sides = geo.polygon_edges(boundary).filter("ay <> by")
    low = F.when(F.col("ay") < F.col("by"), F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))).otherwise(F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    high = F.when(F.col("ay") < F.col("by"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))).otherwise(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")))
    sides = sides.select(low.alias("lo"), high.alias("hi"))
    heights = sides.select("lo.y").union(sides.select("hi.y")).distinct()
    heights = stage(global_positions(heights, [F.col("y")], "band"), "heights")
    bands = heights.select("band", F.col("y").alias("y0")).join(heights.select((F.col("band") - 1).alias("band"), F.col("y").alias("y1")), "band")
    spans = sides.join(heights.select(F.col("y").alias("_y0"), F.col("band").alias("b0")), F.col("lo.y") == F.col("_y0")).join(
        heights.select(F.col("y").alias("_y1"), F.col("band").alias("b1")), F.col("hi.y") == F.col("_y1"))
    cut = spans.select("lo", "hi", F.explode(F.sequence("b0", F.col("b1") - 1)).alias("band")).join(bands, "band")

    def at(y: Column) -> Column:
        exact = F.when(y == F.col("lo.y"), F.col("lo.x")).when(y == F.col("hi.y"), F.col("hi.x"))
        return F.coalesce(exact, F.col("lo.x") + (y - F.col("lo.y")) * (F.col("hi.x") - F.col("lo.x")) / (F.col("hi.y") - F.col("lo.y")))

    placed = cut.select("band", "y0", "y1", at(F.col("y0")).alias("x0"), at(F.col("y1")).alias("x1")).withColumn("mid", F.col("x0") + F.col("x1"))
    # A band holds the sides that cross one height, not the boundary.
    nth = F.row_number().over(Window.partitionBy("band").orderBy("mid", "x0")) - 1
    side = placed.withColumn("n", nth).withColumn("pair", F.floor(F.col("n") / 2))
    first = lambda c: F.max(F.when(F.col("n") % 2 == 0, F.col(c)))
    second = lambda c: F.max(F.when(F.col("n") % 2 == 1, F.col(c)))
    both = side.groupBy("band", "pair", "y0", "y1").agg(first("x0").alias("l0"), first("x1").alias("l1"), second("x0").alias("r0"), second("x1").alias("r1"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    window = F.array(corner("l0", "y0"), corner("r0", "y0"), corner("r1", "y1"), corner("l1", "y1"))
    return both.filter("r0 IS NOT NULL AND (r0 > l0 OR r1 > l1)").select(F.struct("band", "pair").alias("piece_id"), window.alias("window"))


def _box(points: Column) -> Column:
    """West, south, east, north of some points."""
    along = lambda axis: F.transform(points, lambda p: p[axis])
    return F.struct(F.array_min(along("x")).alias("w"), F.array_min(along("y")).alias("s"), F.array_max(along("x")).alias("e"), F.array_max(along("y")).alias("n"))


def _in_cells(boxed: DataFrame, box: str) -> DataFrame:
    """Repeat rows for the grid cells, cx and cy, that their box touches."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL)))
    return boxed.withColumn("cx", cells(f"{box}.w", f"{box}.e")).withColumn("cy", cells(f"{box}.s", f"{box}.n"))


def _box_within(box: str, window: str) -> Column:
    """True when a box lies in a convex window of four corners, anticlockwise."""
    inside = F.lit(True)
    for i in range(4):
        a, b = F.col(window)[i], F.col(window)[(i + 1) % 4]
        for x, y in (("w", "s"), ("e", "s"), ("e", "n"), ("w", "n")):
            inside = inside & (geo.side(F.col(f"{box}.{x}"), F.col(f"{box}.{y}"), a.x, a.y, b.x, b.y) >= 0)
    return inside


def clip_to_boundary(polygons: DataFrame, boundary: DataFrame) -> DataFrame:
    """Polygons cut to a boundary: their columns with ``rings`` (and ``parts``) per convex piece, and piece_id.

    One row per polygon and piece of the boundary that it overlaps; the pieces of a polygon do not overlap, so areas
    add up. Polygons outside have no row. Polygons meet only the pieces in their own grid cells; a pair that shares
    several cells is taken in the first of them.
    """
    pieces = convex_pieces(boundary).withColumn("_of", _box(F.col("window")))
    pieces = stage(_in_cells(pieces, "_of"), "pieces")
    boxed = polygons.filter(F.size("rings") > 0).withColumn("_box", F.explode(F.array(_box(F.flatten("rings")))))
    apart = (F.col("_box.w") > F.col("_of.e")) | (F.col("_box.e") < F.col("_of.w")) | (F.col("_box.s") > F.col("_of.n")) | (F.col("_box.n") < F.col("_of.s"))
    once = [F.col(c) == F.floor(F.greatest(f"_box.{low}", f"_of.{low}") / CELL) for c, low in (("cx", "w"), ("cy", "s"))]
    met = _in_cells(boxed, "_box").join(pieces, ["cx", "cy"]).filter(once[0] & once[1] & ~apart)
    # What lies in a piece is left as it is; only the rest goes side by side through the cut.
    opened = F.transform("rings", geo.open_ring)
    clipped = F.transform("rings", lambda r: geo.clip_ring_to_convex(geo.open_ring(r), F.col("window")))
    cut = geo.keep_rings(met, F.when(_box_within("_box", "window"), opened).otherwise(clipped))
    return cut.select(*polygons.columns, "piece_id")


def clipped_measures(clipped: DataFrame, least_m2: float = 100.0) -> DataFrame:
    """polygon_id and area_m2 of what is left of every polygon; less than ``least_m2`` in all is dropped."""
    key = F.struct("polygon_id", "piece_id")
    kept = [c for c in ("rings", "parts") if c in clipped.columns]
    measured = geo.polygon_measures(clipped.select(key.alias("polygon_id"), *kept))
    total = measured.groupBy(F.col("polygon_id.polygon_id").alias("polygon_id")).agg(F.sum("area_m2").alias("area_m2"))
    return total.filter(F.col("area_m2") >= least_m2)


def thin_shared(polygons: DataFrame, tolerance: float) -> DataFrame:
    """Polygons with fewer corners; a border of two polygons is thinned once and stays the same for both.

    A corner goes when its triangle with the corners beside it is at most ``tolerance`` (square degrees). What
    happens to a corner depends on its place and on the lines that meet there, never on the polygon: corners where
    other than two lines meet stay, and so do those whose removal would lay one line on another. Each round takes
    corners that are less than both corners beside them, by order of magnitude of the triangle and then by a hash, so
    that long runs end in few rounds. Rounds end when nothing is left to take. Neighbours must have the same corners
    along a shared border. Lines of different borders may still come to cross where they run closer than the tolerance.
    """
    pt = "struct<x:double,y:double>"
    corners = polygons.select("polygon_id", F.posexplode(F.transform("rings", geo.open_ring)).alias("ring_no", "ring"))
    corners = stage(corners.select("polygon_id", "ring_no", F.posexplode("ring").alias("i", "p")), "corners")
    sides = polygons.select(F.explode(geo.ring_edges(F.col("rings"))).alias("s")).select(
        F.struct(F.col("s.ax").alias("x"), F.col("s.ay").alias("y")).alias("p"), F.struct(F.col("s.bx").alias("x"), F.col("s.by").alias("y")).alias("q"))
    links = stage(sides.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "links")
    gone = polygons.sparkSession.createDataFrame([], f"v {pt}")
    while True:
        ends = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
        beside = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("a"), F.max("w").alias("b")).filter("n = 2")
        area = F.abs(geo.side(F.col("v.x"), F.col("v.y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))) / 2.0
        size = F.when(area > 0, F.floor(F.log2(area))).otherwise(-2000)
        key = F.struct(size.alias("size"), F.xxhash64("v").alias("h"), F.col("v"))
        free = beside.filter(area <= tolerance).select("v", "a", "b", key.alias("key")).join(links, ["a", "b"], "left_anti")
        free = stage(free, "free")
        about = free.select("key", F.col("v").alias("v0"), F.explode(F.array("a", "b")).alias("v"))
        # Only the lesser of two free corners side by side may go.
        beaten = about.join(free.select("v", F.col("key").alias("other")), "v").filter("other < key").select(F.col("v0").alias("v"))
        taken = stage(first_per_group(free.join(beaten, "v", "left_anti"), ["a", "b"], [F.col("key")]), "taken")
        if taken.isEmpty():
            break
        lost = taken.select("v")
        stay = links.join(lost.select(F.col("v").alias("a")), "a", "left_anti").join(lost.select(F.col("v").alias("b")), "b", "left_anti")
        links = stage(stay.select("a", "b").union(taken.select("a", "b")), "links")
        gone = gone.union(lost)
    left = corners.withColumnRenamed("p", "v").join(gone, "v", "left_anti")
    rings = left.groupBy("polygon_id", "ring_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("ring"))
    whole = rings.groupBy("polygon_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring_no", "ring"))), lambda e: e["ring"]).alias("rings"))
    return polygons.drop("rings").join(whole, "polygon_id").select(*polygons.columns)
