"""Registered queries on clipping, thinning and spelling against large tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgewater.functions import geo
from ridgewater.operators import outlines, spelling
from ridgewater.plans import views as v

# A boundary with a dent in its upper side and a hole: west, south, east, north of the whole, the dent and the hole.
WHOLE, DENT, HOLE = (77.8, 28.9, 80.8, 31.2), (78.9, 30.2, 79.6, 31.2), (78.2, 29.3, 78.6, 29.8)


def _ring(points):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])


def _square(half: float):
    x, y, h = F.col("lon"), F.col("lat"), half
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((-h, -h), (h, -h), (h, h), (-h, h))])


def clipped_squares(spark, sf):
    """What a boundary leaves of a square around every customer; every fifth square has a hole."""
    w, s, e, n = WHOLE
    outer = [(w, s), (e, s), (e, n), (DENT[2], n), (DENT[2], DENT[1]), (DENT[0], DENT[1]), (DENT[0], n), (w, n)]
    hole = [(HOLE[0], HOLE[1]), (HOLE[0], HOLE[3]), (HOLE[2], HOLE[3]), (HOLE[2], HOLE[1])]
    boundary = spark.range(1).select(F.col("id").alias("polygon_id"), F.array(_ring(outer), _ring(hole)).alias("rings"))
    holed = F.col("point_id") % 5 == 0
    squares = v.points(spark, sf).select(
        F.col("point_id").alias("polygon_id"),
        F.when(holed, F.array(_square(0.1), _square(0.03))).otherwise(F.array(_square(0.1))).alias("rings"),
        F.when(holed, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))).alias("parts"),
    )
    cut = outlines.clip_to_boundary(squares, boundary).select("polygon_id", "piece_id", F.posexplode("rings").alias("ring_no", "ring"))
    sides = cut.select("polygon_id", "piece_id", "ring_no", F.inline(geo.ring_edges(F.array("ring"))))
    rings = sides.groupBy("polygon_id", "piece_id", "ring_no").agg((F.abs(F.sum(F.expr("ax * by - bx * ay"))) / 2).alias("area"))
    left = rings.groupBy("polygon_id").agg(F.sum(F.when(F.col("ring_no") == 0, F.col("area")).otherwise(-F.col("area"))).alias("area"))
    return left.filter("area > 1e-7").select("polygon_id", F.round("area", 6).alias("area"))


def _overlap(half: float, box: tuple) -> str:
    w, s, e, n = box
    return f"(greatest(0e0, least(lon+{half}e0, {e}e0) - greatest(lon-{half}e0, {w}e0)) * greatest(0e0, least(lat+{half}e0, {n}e0) - greatest(lat-{half}e0, {s}e0)))"


def _left_of(half: float) -> str:
    return f"({_overlap(half, WHOLE)} - {_overlap(half, DENT)} - {_overlap(half, HOLE)})"


def thinned_borders(spark, sf):
    """Cells of a lattice, one a customer, whose borders are bent at the same places for both neighbours."""
    across = 40
    cell_x, cell_y = F.col("c_custkey") % across, F.floor(F.col("c_custkey") / across)

    def corner(qx, qy):
        # Quarter steps of the lattice; only whole ones, where cells meet, are not moved.
        moved = lambda f: F.when((qx % 4 == 0) & (qy % 4 == 0), 0.0).otherwise(((qx * 7919 + qy * 104729 + f) % 41 - 20) / 1000.0)
        return F.struct((qx / 4.0 + moved(0)).alias("x"), (qy / 4.0 + moved(17)).alias("y"))

    walk = [(i, 0) for i in range(4)] + [(4, i) for i in range(4)] + [(4 - i, 4) for i in range(4)] + [(0, 4 - i) for i in range(4)]
    ring = F.array(*[corner(cell_x * 4 + dx, cell_y * 4 + dy) for dx, dy in walk])
    cells = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("polygon_id"), F.array(ring).alias("rings"))
    thin = outlines.thin_shared(cells, 0.002)
    sides = geo.polygon_edges(thin)
    return sides.groupBy("polygon_id").agg(F.count(F.lit(1)).alias("n_corners"), F.round(F.abs(F.sum(F.expr("ax * by - bx * ay"))) / 2, 6).alias("area"))


def spell_fix_words(spark, sf):
    """Words of benchmark items without their letter e, corrected against all words of all documents."""
    words = lambda c: F.explode(F.split(F.lower(c), "[^a-z]+"))
    asked = v.table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("w"))
    asked = asked.select("item_id", F.replace("w", F.lit("e"), F.lit("")).alias("query")).distinct()
    known = v.table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("place")).filter("place <> ''")
    known = known.groupBy("place").agg(F.min("doc_id").alias("position"))
    return spelling.correct_spelling(asked, "query", known)


QUERIES = {
    "clipped_squares": (
        clipped_squares,
        v.sql(
            "pt",
            f"""SELECT polygon_id, round(area, 6) AS area FROM (SELECT point_id AS polygon_id,
            {_left_of(0.1)} - CASE WHEN point_id % 5 = 0 THEN {_left_of(0.03)} ELSE 0e0 END AS area FROM pt) WHERE area > 1e-7""",
        ),
    ),
    "thinned_borders": (thinned_borders, None),
    "spell_fix_words": (
        spell_fix_words,
        """WITH q AS (SELECT DISTINCT item_id, replace(w, 'e', '') AS query FROM (
          SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark)),
        p AS (SELECT place, min(doc_id) AS position FROM (
          SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS place FROM documents) WHERE place <> '' GROUP BY 1),
        scored AS (SELECT query, place, position, 1e0 - levenshtein(query, place)::DOUBLE / greatest(length(query), length(place)) AS score
          FROM (SELECT DISTINCT query FROM q WHERE query <> '') u JOIN p
          ON abs(length(query) - length(place)) <= 0.4e0 * greatest(length(query), length(place)) + 1e-9),
        best AS (SELECT query, place FROM scored WHERE score >= 0.6e0
          QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, position, place) = 1)
        SELECT item_id, q.query, coalesce(place, q.query) AS fixed FROM q LEFT JOIN best ON best.query = q.query""",
    ),
}
