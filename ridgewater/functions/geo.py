"""Geometry as plain Spark columns: everything here stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.19492664455873  # EARTH_RADIUS_KM * pi / 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between two points in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2.0 * EARTH_RADIUS_KM)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000.0


def foot_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Position 0..1 along a-b of the planar foot of the perpendicular from p."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.when(length2 > 0, length2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def segment_km(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Ground distance from p to segment a-b: the foot is planar in lon/lat, the length spherical."""
    t = foot_fraction(px, py, ax, ay, bx, by)
    return haversine_km(py, px, ay + t * (by - ay), ax + t * (bx - ax))


def side(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Twice the signed area of (a, b, p): positive when p is left of a->b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def crosses_right(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 when the edge a-b crosses the horizontal ray from p to the right, else 0."""
    s = side(px, py, ax, ay, bx, by)
    up = (ay <= py) & (by > py) & (s > 0)
    down = (by <= py) & (ay > py) & (s < 0)
    return (up | down).cast("int")


def crosses_above(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 when the edge a-b crosses the vertical ray from p upwards, else 0.

    A point on the edge counts as right of it, as in crosses_right: below a rising edge, above a falling one.
    """
    s = side(px, py, ax, ay, bx, by)
    tie = (s == 0) & ((bx - ax) * (by - ay) > 0)
    east = (ax <= px) & (bx > px) & ((s < 0) | tie)
    west = (bx <= px) & (ax > px) & ((s > 0) | tie)
    return (east | west).cast("int")


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """True when p lies exactly on the closed segment a-b."""
    return (
        (side(px, py, ax, ay, bx, by) == 0)
        & px.between(F.least(ax, bx), F.greatest(ax, bx))
        & py.between(F.least(ay, by), F.greatest(ay, by))
    )


def segments_intersect(a: tuple, b: tuple, c: tuple, d: tuple, touching: bool = True) -> Column:
    """True when closed segments a-b and c-d share a point. Each argument is an (x, y) pair.

    Their boxes overlap and neither segment lies wholly on one side of the other. Without ``touching`` each has to
    pass through the inside of the other; an end that only lies on the other segment does not count.
    """
    boxes = None
    for k in (0, 1):
        overlap = (F.least(a[k], b[k]) <= F.greatest(c[k], d[k])) & (F.least(c[k], d[k]) <= F.greatest(a[k], b[k]))
        boxes = overlap if boxes is None else boxes & overlap
    most = 0 if touching else -1
    split_ab = F.signum(side(*c, *a, *b)) * F.signum(side(*d, *a, *b)) <= most
    split_cd = F.signum(side(*a, *c, *d)) * F.signum(side(*b, *c, *d)) <= most
    return boxes & split_ab & split_cd


def crossing_fraction(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Position along a-b where it meets the line through c and d; null when parallel."""
    den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    num = (c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])
    return num / F.when(den != 0, den)


COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def compass(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2 as one of eight compass names."""
    d_lon = F.radians(lon2 - lon1)
    y = F.sin(d_lon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(d_lon)
    slot = F.pmod(F.floor((F.degrees(F.atan2(y, x)) + 382.5) / 45.0), F.lit(8)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), slot + 1)


def utm44(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres on UTM zone 44N (WGS 84), by the closed transverse Mercator series."""
    # WGS 84 ellipsoid, scale 0.9996, central meridian 81 E, false easting 500 km.
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    ]
    root = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - 81.0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.atanh(s * root) * root)
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(t * t + 1.0))
    east, north = eta, xi
    for j, alpha in enumerate(series, start=1):
        east = east + F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * alpha
        north = north + F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * alpha
    return east * (k0 * radius) + 500000.0, north * (k0 * radius)


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """(lat, lon) halfway along a short straight edge."""
    return (lat1 + lat2) / 2.0, (lon1 + lon2) / 2.0


def lon_scale(lat: Column) -> Column:
    """How much shorter a degree of longitude is than one of latitude."""
    return F.cos(F.radians(lat))


def rain_cell(lat: Column, lon: Column, size: float = 0.1) -> tuple[Column, Column]:
    """Key of the shared rainfall cell: nearest multiple of ``size``, halves to even."""
    return F.bround(lat / size).cast("long"), F.bround(lon / size).cast("long")


def block(lat: Column, lon: Column, size: float = 0.25) -> tuple[Column, Column]:
    """Spatial cross-validation block: coordinates divided by ``size`` and truncated."""
    return (lat / size).cast("long"), (lon / size).cast("long")


def grid_index(lat: Column, lon: Column, lat0: float, lon0: float, size: float) -> tuple[Column, Column]:
    """Row and column of a lookup grid with its first cell at (lat0, lon0)."""
    return F.floor((lat - lat0) / size).cast("long"), F.floor((lon - lon0) / size).cast("long")


def coordinate_key(lat: Column, lon: Column, places: int = 5) -> tuple[Column, Column]:
    """Coordinates as whole numbers of 10**-places degrees, for equality joins."""
    return F.round(lat * 10**places).cast("long"), F.round(lon * 10**places).cast("long")


def ring_edges(rings: Column) -> Column:
    """Array of struct(ax, ay, bx, by) for every side of every ring; rings may be left open."""

    def sides(ring: Column) -> Column:
        closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(
            F.concat(ring, F.slice(ring, 1, 1))
        )
        return F.zip_with(
            F.slice(closed, F.lit(1), F.size(closed) - 1),
            F.slice(closed, F.lit(2), F.size(closed) - 1),
            lambda p, q: F.struct(p.x.alias("ax"), p.y.alias("ay"), q.x.alias("bx"), q.y.alias("by")),
        )

    return F.flatten(F.transform(rings, sides))


def polygon_edges(polygons: DataFrame, keep: tuple = ()) -> DataFrame:
    """One row per polygon side: polygon_id, the ``keep`` columns, ax, ay, bx, by."""
    return polygons.select("polygon_id", *keep, F.inline(ring_edges(F.col("rings"))))


def polygon_measures(polygons: DataFrame) -> DataFrame:
    """Area in m2 and hectares (on UTM 44N) and centroid in degrees, per polygon.

    The first ring of a part is its outline and the others are its holes, whichever way they turn. ``parts``, if
    there is such a column, holds the part number of every ring; without it all rings are one part.
    """
    part = F.col("parts") if "parts" in polygons.columns else F.transform("rings", lambda r: F.lit(0))
    role = F.transform(part, lambda p, i: F.when((i == 0) | (F.get(part, i - 1) != p), 1).otherwise(-1))
    rings = polygons.select("polygon_id", F.posexplode(F.arrays_zip(F.col("rings").alias("ring"), role.alias("role"))).alias("ring_no", "r"))
    edges = rings.select("polygon_id", "ring_no", F.col("r.role").alias("role"), F.inline(ring_edges(F.array("r.ring"))))
    ex1, ey1 = utm44(F.col("ay"), F.col("ax"))
    ex2, ey2 = utm44(F.col("by"), F.col("bx"))
    cross_deg = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    of_ring = edges.groupBy("polygon_id", "ring_no", "role").agg(
        F.sum(ex1 * ey2 - ex2 * ey1).alias("_area2"),
        F.sum(cross_deg).alias("_deg2"),
        F.sum((F.col("ax") + F.col("bx")) * cross_deg).alias("_cx"),
        F.sum((F.col("ay") + F.col("by")) * cross_deg).alias("_cy"),
    )
    turn = F.col("role") * F.signum("_deg2")
    sums = of_ring.groupBy("polygon_id").agg(
        F.sum(F.col("role") * F.abs("_area2")).alias("_area2"),
        *[F.sum(F.col(c) * turn).alias(c) for c in ("_deg2", "_cx", "_cy")],
    )
    return sums.select(
        "polygon_id",
        (F.abs(F.col("_area2")) / 2.0).alias("area_m2"),
        (F.abs(F.col("_area2")) / 20000.0).alias("area_ha"),
        (F.col("_cx") / (F.col("_deg2") * 3.0)).alias("centroid_lon"),
        (F.col("_cy") / (F.col("_deg2") * 3.0)).alias("centroid_lat"),
    )


def representative_points(polygons: DataFrame) -> DataFrame:
    """A point inside every polygon: polygon_id, lat, lon; holes and several parts are respected.

    The line halfway up the polygon is cut by its sides; the middle of the widest stretch inside is the point. Sides
    count at their lower end only, so a line through corners is cut an even number of times. A polygon without height
    has no such stretch and no row. A polygon's list holds its sides on that line, no others.
    """
    sides = polygon_edges(polygons)
    middle = sides.groupBy("polygon_id").agg(((F.min("ay") + F.max("ay")) / 2.0).alias("lat"))
    cut = sides.join(middle, "polygon_id").filter((F.col("ay") > F.col("lat")) != (F.col("by") > F.col("lat")))
    at = F.col("ax") + (F.col("lat") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    lines = cut.groupBy("polygon_id", "lat").agg(F.sort_array(F.collect_list(at)).alias("x"))
    stretch = F.transform(
        F.sequence(F.lit(0), F.size("x") - 2, F.lit(2)),
        lambda i: F.struct((F.get("x", i + 1) - F.get("x", i)).alias("width"), (-i).alias("first"), ((F.get("x", i) + F.get("x", i + 1)) / 2.0).alias("lon")),
    )
    return lines.select("polygon_id", "lat", F.array_max(stretch)["lon"].alias("lon"))


def clip_ring_to_box(ring: Column, west: float, south: float, east: float, north: float) -> Column:
    """A ring cut to an axis-parallel box, one box side after the other."""
    for axis, limit, sign in (("x", west, 1.0), ("x", east, -1.0), ("y", south, 1.0), ("y", north, -1.0)):
        ring = _cut_ring(ring, axis, limit, sign)
    return ring


def _cut_ring(ring: Column, axis: str, limit: float, sign: float) -> Column:
    """Part of a ring on one side of a line."""
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    pairs = F.zip_with(ring, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def cut(pair: Column) -> Column:
        p, q = pair.p, pair.q
        p_in, q_in = (p[axis] - limit) * sign >= 0, (q[axis] - limit) * sign >= 0
        t = F.try_divide(F.lit(limit) - p[axis], q[axis] - p[axis])
        hit = F.struct((p.x + t * (q.x - p.x)).alias("x"), (p.y + t * (q.y - p.y)).alias("y"))
        nothing = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(p_in & q_in, F.array(q)).when(p_in, F.array(hit)).when(q_in, F.array(hit, q)).otherwise(nothing)

    return F.flatten(F.transform(pairs, cut))


def open_ring(ring: Column) -> Column:
    """A ring without the repetition of its first point at its end."""
    closed = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def clip_ring_to_convex(ring: Column, window: Column) -> Column:
    """An open ring cut to a convex window (its corners, anticlockwise), one side of the window after the other."""
    following = F.concat(F.slice(window, F.lit(2), F.size(window) - 1), F.slice(window, 1, 1))
    sides = F.zip_with(window, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cut(points: Column, s: Column) -> Column:
        left = lambda p: side(p.x, p.y, s.a.x, s.a.y, s.b.x, s.b.y)
        after = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
        steps = F.zip_with(points, after, lambda p, q: F.struct(p.alias("p"), q.alias("q"), left(p).alias("dp"), left(q).alias("dq")))

        def kept(e: Column) -> Column:
            t = F.try_divide(e.dp, e.dp - e.dq)
            hit = F.struct((e.p.x + t * (e.q.x - e.p.x)).alias("x"), (e.p.y + t * (e.q.y - e.p.y)).alias("y"))
            nothing = F.array().cast("array<struct<x:double,y:double>>")
            return F.when((e.dp >= 0) & (e.dq >= 0), F.array(e.q)).when(e.dp >= 0, F.array(hit)).when(e.dq >= 0, F.array(hit, e.q)).otherwise(nothing)

        return F.flatten(F.transform(steps, kept))

    # Spark takes a fold's state as what its start is, so the start's points must be nullable like the cut ones.
    return F.aggregate(sides, ring.cast("array<struct<x:double,y:double>>"), cut)


def keep_rings(polygons: DataFrame, rings: Column) -> DataFrame:
    """Polygons with new rings in place of theirs, one for one; rings of fewer than three points go, with their parts."""
    # As a generator's output: the filter below would otherwise be pushed down and work the rings out once more.
    kept = polygons.withColumn("rings", F.explode(F.array(rings)))
    if "parts" in polygons.columns:
        numbered = F.filter(F.arrays_zip(F.col("rings").alias("ring"), F.col("parts").alias("part")), lambda z: F.size(z["ring"]) >= 3)
        kept = kept.withColumn("parts", F.transform(numbered, lambda z: z["part"]))
    return kept.withColumn("rings", F.filter("rings", lambda r: F.size(r) >= 3)).filter(F.size("rings") > 0)


def clip_to_box(polygons: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Polygons cut to a box; polygons left with no area are dropped."""
    return keep_rings(polygons, F.transform("rings", lambda r: clip_ring_to_box(open_ring(r), west, south, east, north)))


def thin_ring(ring: Column, tolerance: float) -> Column:
    """Vertex decimation: a vertex stays if it is farther than ``tolerance`` from the last kept one.

    Ends always stay. This does not preserve topology between neighbouring polygons.
    """
    inner = F.aggregate(
        F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 2, F.lit(0))),
        F.slice(ring, 1, 1),
        lambda kept, p: F.when(
            F.hypot(p.x - F.element_at(kept, -1).x, p.y - F.element_at(kept, -1).y) > tolerance,
            F.concat(kept, F.array(p)),
        ).otherwise(kept),
    )
    return F.concat(inner, F.slice(ring, -1, 1))
