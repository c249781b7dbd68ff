"""GeoJSON layers in and out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewater.functions.geo import thin_ring
from ridgewater.operators.scale import first_per_group

_FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
_POINT = "array<struct<x:double,y:double>>"


def _rings(kind: Column, coordinates: Column) -> Column:
    """All rings of a Polygon or MultiPolygon as array<array<struct<x, y>>>; null for anything else."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    raw = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi)
    return F.transform(
        raw, lambda ring: F.transform(ring, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))
    )


def _parts(kind: Column, coordinates: Column) -> Column:
    """The part number of every ring."""
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    numbered = F.flatten(F.transform(multi, lambda polygon, i: F.transform(polygon, lambda ring: i)))
    polygon = F.transform(F.from_json(coordinates, "array<array<array<double>>>"), lambda ring: F.lit(0))
    return F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", numbered)


def _feature_mark(spark: SparkSession, path: str) -> str | None:
    """How the first file writes the start of a feature, up to its type; None where the type does not come first."""
    head = spark.read.text(path, lineSep='"Feature"').first()
    found = re.search(r'\{\s*"type"\s*:\s*$', head["value"]) if head else None
    return found.group(0) + '"Feature"' if found else None


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of a layer: position (order in the files), properties (map), geometry_type, coordinates (JSON text).

    A file holds one FeatureCollection, Feature or bare geometry; with ``lines`` every line is one of these. A large
    collection is split between tasks at the starts of its features: the text source takes what writers put there
    (``{ "type": "Feature"``, with the white space of the first file) as its line end. A broken feature is then lost
    alone. Files that write it otherwise, or other members first, are read whole, each in one task. A feature nested
    in another's properties is not expected.
    """
    mark = None if lines else _feature_mark(spark, path)
    if mark is None:
        text = spark.read.text(path, wholetext=not lines).select("value", F.lit(False).alias("part"))
    else:
        # What follows a mark never starts with a brace; the beginning of a file does.
        text = spark.read.text(path, lineSep=mark).select("value", (~F.col("value").rlike("^\\s*\ufeff?\\s*\\{")).alias("part"))
        text = text.filter("length(trim(value)) > 0")
    whole = F.from_json("value", f"struct<type:string,features:array<{_FEATURE}>,properties:map<string,string>,"
                                 "geometry:struct<type:string,coordinates:string>,coordinates:string>")
    # Between two marks: the rest of a feature and a comma; after the last, the end of the collection, which the parser leaves unread.
    rest = F.regexp_replace("value", r",\s*$", "")
    parts = F.from_json(F.concat(F.lit("[" + (mark or "")), rest, F.lit("]")), f"array<{_FEATURE}>")
    one = F.struct(F.col("v.type").alias("type"), F.col("v.properties").alias("properties"), F.col("v.geometry").alias("geometry"))
    bare = F.struct(
        F.lit("Feature").alias("type"), F.lit(None).cast("map<string,string>").alias("properties"),
        F.struct(F.col("v.type").alias("type"), F.col("v.coordinates").alias("coordinates")).alias("geometry"),
    )
    features = (
        F.when(F.col("part"), F.col("p"))
        .when(F.col("v.type") == "FeatureCollection", F.col("v.features"))
        .when(F.col("v.type") == "Feature", F.array(one))
        .otherwise(F.array(bare))
    )
    found = text.select("part", F.when(~F.col("part"), whole).alias("v"), F.when(F.col("part"), parts).alias("p"))
    if mark is not None:
        found = found.filter("part OR v.type IS NOT NULL")
    found = found.select(F.explode(features).alias("f")).withColumn("position", F.monotonically_increasing_id())
    return found.select(
        "position",
        F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )


def read_polygons(spark: SparkSession, path: str, id_property: str | None = None, lines: bool = False) -> DataFrame:
    """Polygon features: polygon_id, position, properties, rings and parts (the part of a multipolygon each ring is
    in; the first ring of a part is its outline). Broken and non-polygon features are dropped.

    Without an id property the id is a hash of the geometry.
    """
    f = read_features(spark, path, lines)
    key = F.col("properties")[id_property].cast("long") if id_property else F.xxhash64("coordinates")
    geometry = F.col("geometry_type"), F.col("coordinates")
    out = f.select(key.alias("polygon_id"), "position", "properties", _rings(*geometry).alias("rings"), _parts(*geometry).alias("parts"))
    sound = F.forall("rings", lambda r: (F.size(r) >= 3) & F.forall(r, lambda p: p.x.isNotNull() & p.y.isNotNull()))
    return out.filter(F.col("rings").isNotNull() & (F.size("rings") > 0) & sound)


def read_hazard_polygons(spark: SparkSession, path: str, class_property: str = "hazard", lines: bool = False) -> DataFrame:
    """Polygons of the four hazard classes."""
    from ridgewater.functions.status import CLASS_ORDER

    out = read_polygons(spark, path, lines=lines).withColumn("hazard_class", F.upper(F.col("properties")[class_property]))
    return out.filter(F.col("hazard_class").isin(*CLASS_ORDER))


def read_watersheds(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Catchments with areas; the first feature of an id in the file is kept."""
    out = read_polygons(spark, path, "HYBAS_ID", lines).select(
        "polygon_id", F.col("properties")["UP_AREA"].try_cast("double").alias("up_area_km2"),
        F.col("properties")["SUB_AREA"].try_cast("double").alias("sub_area_km2"), "rings", "parts", "position",
    )
    return first_per_group(out, ["polygon_id"], [F.col("position")]).drop("position")


def read_districts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Named polygons of admin level 5, without the word district in their names."""
    out = read_polygons(spark, path, lines=lines)
    name = F.trim(F.replace(F.col("properties")["name"], F.lit(" district"), F.lit("")))
    return out.filter((F.col("properties")["admin_level"] == "5") & (F.coalesce(name, F.lit("")) != "")).select(
        "polygon_id", name.alias("name"), "rings", "parts"
    )


def read_points(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Point features: properties, lat, lon."""
    f = read_features(spark, path, lines).filter("geometry_type = 'Point'")
    xy = F.from_json("coordinates", "array<double>")
    return f.select("properties", F.element_at(xy, 2).alias("lat"), F.element_at(xy, 1).alias("lon"))


def _coordinates(ring: Column, tolerance: float) -> Column:
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    kept = thin_ring(closed, tolerance) if tolerance > 0 else closed
    return F.transform(kept, lambda p: F.array(p.x, p.y))


# Fixed list of tables that may be exported by name.
EXPORTABLE = ("hazard_zones", "watersheds", "districts", "localities", "shelters", "roads")


def feature_lines(layer: DataFrame, properties: list[str], simplify: float = 0.0) -> DataFrame:
    """One GeoJSON Feature per row as text column ``value``; polygon rings, lines (x1..y2) or points (lat, lon)."""
    if "rings" in layer.columns:
        part = F.col("parts") if "parts" in layer.columns else F.transform("rings", lambda r: F.lit(0))
        closed = F.transform("rings", lambda r: _coordinates(r, simplify))
        numbered = F.zip_with(closed, part, lambda r, p: F.struct(r.alias("ring"), p.alias("part")))
        of_part = lambda p: F.transform(F.filter(numbered, lambda n: n["part"] == p), lambda n: n["ring"])
        polygons = F.transform(F.array_distinct(part), of_part)
        # A polygon's coordinates are one level less deep than a multipolygon's, so they are put in as text.
        one = F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.get(polygons, F.lit(0))), F.lit("}"))
        many = F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(polygons), F.lit("}"))
        geometry = F.when(F.size(polygons) > 1, many).otherwise(one)
    elif "x1" in layer.columns:
        ends = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
        geometry = F.struct(F.lit("LineString").alias("type"), ends.alias("coordinates"))
    else:
        geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    props = F.struct(*properties) if properties else F.struct(F.lit(None).cast("string").alias("none"))
    if "rings" not in layer.columns:
        geometry = F.to_json(geometry)
    value = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(props), F.lit(',"geometry":'), geometry, F.lit("}"))
    return layer.select(value.alias("value"))


def write_layer(layer: DataFrame, table: str, properties: list[str], path: str, simplify: float = 0.0) -> None:
    """Write a layer as one Feature per line, in as many files as there are tasks."""
    if table not in EXPORTABLE:
        raise ValueError(f"not an exportable table: {table}")
    feature_lines(layer, properties, simplify).write.mode("overwrite").text(path)


def hazardous_roads(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of classes 2..4 with their end positions, worst first."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    bad = edges.filter(F.col("hazard_code").isin(2, 3, 4))
    return bad.join(a, "src").join(b, "dst").orderBy(F.desc("hazard_code"), "src", "dst")
