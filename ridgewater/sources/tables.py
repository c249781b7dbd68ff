"""CSV and JSON inputs, CAP warnings, and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewater.functions.text import cause_class
from ridgewater.operators.scale import first_per_group, ordered_totals

# Column names of the catalogue in its two layouts, and the columns it cannot do without.
CATALOGUE_COLUMNS = {
    "event_id": ("event_id", "id"),
    "date": ("event_date", "date"),
    "lat": ("latitude",),
    "lon": ("longitude",),
    "accuracy": ("location_accuracy",),
    "trigger": ("landslide_trigger", "trigger"),
    "category": ("landslide_category", "landslide_type"),
    "size": ("landslide_size",),
    "fatalities": ("fatality_count", "fatalities"),
    "title": ("event_title", "location_description", "nearest_places"),
    "source": ("source_name",),
}
REQUIRED = ("date", "lat", "lon", "accuracy", "trigger")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy", "M/d/yyyy", "M/d/yy", "yyyy-MM-dd'T'HH:mm:ss.SSS")


def any_date(text: Column) -> Column:
    """First reading of a date in any known format."""
    return F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS], F.try_to_timestamp(text)))


def normalise_catalogue(raw: DataFrame) -> DataFrame:
    """Either layout of the landslide catalogue under one schema; raises when a needed column is absent."""
    known = {c.lower().strip(): c for c in raw.columns}
    picked = {field: next((known[n] for n in names if n in known), None) for field, names in CATALOGUE_COLUMNS.items()}
    missing = [f for f in REQUIRED if picked[f] is None]
    if missing:
        raise ValueError(f"catalogue lacks {missing}; found {raw.columns}")
    quoted = {f: F.col(f"`{c}`") if c else F.lit(None).cast("string") for f, c in picked.items()}
    return raw.select(
        quoted["event_id"].cast("string").alias("event_id"),
        any_date(quoted["date"]).alias("day"),
        quoted["lat"].try_cast("double").alias("lat"),
        quoted["lon"].try_cast("double").alias("lon"),
        *[quoted[f].cast("string").alias(f) for f in ("accuracy", "trigger", "category", "size", "title", "source")],
        quoted["fatalities"].try_cast("int").alias("fatalities"),
    ).filter("day IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return normalise_catalogue(spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"'))


def read_inventory(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """Flood inventory CSV: event_id, district, start, end, kind, cause, deaths; one row per named district.

    Every column is read as text and undecodable bytes are replaced. District names and codes are parallel
    lists; codes are blanked when the lists differ in length. ``codes``: code, district. The end is capped at
    six days after the start and falls back to the start.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True, escape='"')
    split = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), F.trim)
    names, listed = split("Districts"), split("District_LGD_Codes")
    padded = F.when(F.size(listed) == F.size(names), listed).otherwise(F.array_repeat(F.lit(""), F.size(names)))
    stamp = lambda c: F.to_date(F.try_to_timestamp(F.trim(F.col(f"`{c}`")), F.lit("dd-MM-yyyy HH:mm")))
    pairs = raw.select(
        F.col("UEI").alias("event_id"), stamp("Start Date").alias("start"), stamp("End Date").alias("_end"),
        F.col("`Main Cause`").alias("cause"), F.col("`Human fatality`").alias("deaths"),
        F.explode(F.arrays_zip(names.alias("name"), padded.alias("code"))).alias("p"),
    ).filter("start IS NOT NULL")
    placed = pairs.join(codes.select(F.col("code").alias("_code"), F.col("district").alias("_d")), F.col("p.code") == F.col("_code"), "left")
    # One spelling has no code of its own in the inventory.
    by_name = F.when(F.lower("p.name").startswith("uttar kashi kashi"), "Uttarkashi")
    end = F.least(F.greatest(F.coalesce("_end", "start"), F.col("start")), F.date_add("start", 6))
    return placed.select(
        "event_id", F.coalesce("_d", by_name).alias("district"), "start", end.alias("end"), cause_class(F.col("cause")).alias("kind"),
        "cause", "deaths",
    ).filter("district IS NOT NULL").dropDuplicates(["event_id", "district"])


def read_rain_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A folder of point-year records: district, lat, lon, year, start, precipitation_mm (array)."""
    schema = "district string, lat double, lon double, year int, start string, precipitation_mm array<double>"
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_shelters(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Shelters of one JSON list per file or, with ``lines``, of one object per line, which is split between tasks."""
    schema = "id string, name string, kind string, amenity string, lat double, lon double"
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    return raw.select(
        F.col("id").alias("target_id"), "name", "kind", F.coalesce("amenity", "kind").alias("category"),
        (F.col("kind") == "shelter").alias("is_evacuation_target"), "lat", "lon",
    )


def read_soil(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Soil samples with a usable group; ``lines`` as for shelters."""
    schema = "lat double, lon double, soil struct<sand:double,clay:double,silt:double,hydrologic_soil_group:string>"
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    return raw.select(
        "lat", "lon", F.col("soil.sand").alias("sand_pct"), F.col("soil.clay").alias("clay_pct"), F.col("soil.silt").alias("silt_pct"),
        F.col("soil.hydrologic_soil_group").alias("hsg"),
    ).filter("hsg IS NOT NULL")


# Amenities that become shelters and hospitals.
SHELTER_AMENITIES = ["shelter", "community_centre", "social_facility"]
HOSPITAL_AMENITIES = ["hospital"]


def places_of_interest(pois: DataFrame) -> DataFrame:
    """Shelters and hospitals from tagged places: target_id, name, kind, amenity, lat, lon.

    ``pois``: id, tags (map), lat, lon (the centroid of the shape).
    """
    amenity = F.col("tags")["amenity"]
    kind = F.when(amenity.isin(*SHELTER_AMENITIES), "shelter").when(amenity.isin(*HOSPITAL_AMENITIES), "hospital")
    name = F.nullif(F.trim(F.col("tags")["name"]), F.lit(""))
    default = F.concat(F.lit("Unnamed "), F.initcap("kind"))
    return pois.select(
        F.concat(F.lit("osm-"), F.col("id").cast("string")).alias("target_id"), name.alias("_n"), kind.alias("kind"),
        amenity.alias("amenity"), "lat", "lon",
    ).filter("kind IS NOT NULL AND lat IS NOT NULL").select("target_id", F.coalesce("_n", default).alias("name"), "kind", "amenity", "lat", "lon")


_INFO = (
    "array<struct<language:string,event:string,severity:string,urgency:string,certainty:string,effective:string,"
    "expires:string,headline:string,description:string,instruction:string,area:array<struct<areaDesc:string>>>>"
)
CAP_SCHEMA = (
    "identifier string, sender string, sent string, status string, msgType string, references string, info " + _INFO
)


def read_cap(spark: SparkSession, path: str) -> DataFrame:
    """CAP documents, one warning per <alert>; a file may hold many, and large files are split between tasks."""
    return cap_rows(spark.read.format("xml").option("rowTag", "alert").option("ignoreNamespace", "true").schema(CAP_SCHEMA).load(path))


def cap_from_text(docs: DataFrame, column: str = "value") -> DataFrame:
    """The same from a text column of whole documents."""
    rest = [c for c in docs.columns if c != column]
    return cap_rows(docs.select(*rest, F.from_xml(column, CAP_SCHEMA, {"ignoreNamespace": "true"}).alias("a")).select(*rest, "a.*"))


def cap_rows(alerts: DataFrame) -> DataFrame:
    """Warning fields in English (else the first language), with the Hindi headline and description beside them."""
    starts = lambda p: F.filter("info", lambda i: F.lower(F.trim(F.coalesce(i.language, F.lit("")))).startswith(p))
    english = F.coalesce(F.try_element_at(starts("en"), F.lit(1)), F.try_element_at("info", F.lit(1)))
    hindi = F.try_element_at(starts("hi"), F.lit(1))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rest = [c for c in alerts.columns if c not in ("identifier", "sender", "sent", "status", "msgType", "references", "info")]
    picked = alerts.filter(F.size("info") > 0).select("*", english.alias("_en"), hindi.alias("_hi"))
    areas = F.filter(F.transform("_en.area", lambda a: text(a.areaDesc)), lambda d: d != "")
    return picked.select(
        *rest,
        *[text(F.col(c)).alias(n) for c, n in (("identifier", "identifier"), ("sender", "sender"), ("sent", "sent"),
                                               ("status", "status"), ("msgType", "msg_type"), ("references", "references"))],
        *[text(F.col(f"_en.{c}")).alias(c) for c in ("event", "severity", "urgency", "certainty", "effective", "expires",
                                                      "headline", "description", "instruction")],
        text(F.col("_hi.headline")).alias("headline_hi"),
        text(F.col("_hi.description")).alias("description_hi"),
        F.array_join(areas, "; ").alias("area"),
    )


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of an RSS feed: guid, link, author, title."""
    schema = "guid string, link string, author string, title string"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows plus incoming rows whose key is new. As with a SQL UNIQUE key, a null makes a row distinct."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    fresh = first_per_group(incoming.filter(whole), keys, order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(existing.columns)).unionByName(incoming.filter(~whole).select(existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest version of each key from both tables."""
    return first_per_group(existing.unionByName(incoming), keys, [F.desc(version)])


def merge_passes(passes: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union of passes in which an earlier pass wins a key; adds ``pass``."""
    out = None
    for i, df in enumerate(passes, 1):
        part = df.withColumn("pass", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return first_per_group(out, keys, [F.col("pass"), *order])


def write_thresholds(points: DataFrame, validation: DataFrame, path: str) -> None:
    """Threshold table with its validation scores, one JSON object per point.

    ``points``: point_id, window_name, watch, critical. The validation table has a row per level.
    """
    scores = validation.agg(F.to_json(F.collect_list(F.struct(*validation.columns))).alias("validation"))  # one row per level
    nested = points.groupBy("point_id").agg(
        F.map_from_entries(F.collect_list(F.struct("window_name", F.struct("watch", "critical")))).alias("thresholds_mm")  # one per window
    )
    nested.join(F.broadcast(scores), F.lit(True)).write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    schema = "point_id long, thresholds_mm map<string,struct<watch:double,critical:double>>, validation string"
    raw = spark.read.schema(schema).json(path)
    return raw.select("point_id", F.explode("thresholds_mm").alias("window_name", "_t")).select("point_id", "window_name", "_t.watch", "_t.critical")


def fetch_plan(points: DataFrame, years: list[int], landed: DataFrame, cost: float | Column, budget: float) -> DataFrame:
    """Point-years still to fetch within a call budget, newest year first: point_id, year, spent.

    ``cost`` is one number or a column of ``points``. The running cost is summed over ranges of the order, so no
    task sees all rows.
    """
    price = cost if isinstance(cost, Column) else F.lit(float(cost))
    wanted = points.select("point_id", price.alias("_cost"), F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
    todo = wanted.join(landed.select("point_id", "year"), ["point_id", "year"], "left_anti")
    spent = ordered_totals(todo, [F.desc("year"), F.asc("point_id")], {"spent": F.col("_cost")})
    return spent.filter(F.col("spent") <= budget).select("point_id", "year", "spent")
