"""Hash-ordered sampling and training tables: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewater.functions.geo import KM_PER_DEGREE, haversine_km
from ridgewater.operators.scale import global_positions, spread_join, top_per_group
from ridgewater.operators.spatial import containing_polygons, grid_nodes_in, nearest_k, polygon_index
from ridgewater.session import stage


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _open_cells(region: DataFrame, events: DataFrame, size: float, away_km: float) -> DataFrame:
    """Cells of the region that no single event takes whole: cell_row, cell_col."""
    cells = polygon_index(region, size).select("cell_row", "cell_col").distinct()
    places = events.select(F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon")).dropna().distinct()
    d_lat = away_km / KM_PER_DEGREE
    d_lon = F.lit(d_lat) / F.cos(F.radians(F.least(F.lit(89.0), F.abs("e_lat") + d_lat)))
    rows = F.sequence(F.floor((F.col("e_lat") - d_lat) / size), F.floor((F.col("e_lat") + d_lat) / size))
    cols = F.sequence(F.floor((F.col("e_lon") - d_lon) / size), F.floor((F.col("e_lon") + d_lon) / size))
    near = places.withColumn("cell_row", F.explode(rows)).withColumn("cell_col", F.explode(cols))
    corners = [
        haversine_km((F.col("cell_row") + r) * size, (F.col("cell_col") + c) * size, F.col("e_lat"), F.col("e_lon"))
        for r in (0, 1)
        for c in (0, 1)
    ]
    taken = near.filter(F.greatest(*corners) < away_km * 0.999).select("cell_row", "cell_col").distinct()
    return stage(cells.join(taken, ["cell_row", "cell_col"], "left_anti"), "open-cells")


def background_points(
    events: DataFrame,
    region: DataFrame,
    box: tuple[float, float, float, float],
    n: int,
    candidates: int,
    seed: int = 42,
    away_km: float = 5.0,
    settlements: DataFrame | None = None,
    settled_km: float = 10.0,
    barren: int = 20,
) -> DataFrame:
    """``n`` uniform points in the region, at least ``away_km`` from every event.

    With ``settlements`` they are also within ``settled_km`` of one. Points are numbered and fixed by number and seed;
    ranges of ``candidates`` numbers, or more when few qualify, are drawn until there are ``n``, and the last range is
    cut to what is missing by the exact order of a hash. Only points in cells that no event takes whole are looked at
    closely. Fewer come back only when no such cell is left or after ``barren`` ranges in a row without a single point
    that qualifies, which means that the region has no room.
    """
    west, south, east, north = box
    spark = events.sparkSession
    size = max(away_km / KM_PER_DEGREE / 4.0, 0.001)
    cells = _open_cells(region, events, size, away_km)
    room = not cells.isEmpty()

    def qualified(start: int, width: int) -> DataFrame:
        drawn = spark.range(start, start + width).select(
            F.col("id").alias("point_id"),
            (F.lit(south) + uniform(F.col("id"), seed, 1) * (north - south)).alias("lat"),
            (F.lit(west) + uniform(F.col("id"), seed, 2) * (east - west)).alias("lon"),
        )
        placed = drawn.withColumn("cell_row", F.floor(F.col("lat") / size)).withColumn("cell_col", F.floor(F.col("lon") / size))
        drawn = stage(spread_join(placed, cells, ["cell_row", "cell_col"], "point_id", "left_semi").select("point_id", "lat", "lon"), "drawn")
        inside = containing_polygons(drawn, region).select("point_id").distinct()
        kept = drawn.join(inside, "point_id", "left_semi")
        targets = events.select(F.col("event_id").alias("target_id"), "lat", "lon")
        kept = kept.join(nearest_k(kept, targets, 1, away_km).select("point_id"), "point_id", "left_anti")
        if settlements is not None:
            towns = settlements.select("target_id", "lat", "lon")
            kept = kept.join(nearest_k(kept, towns, 1, settled_km).select("point_id"), "point_id", "left_semi")
        return stage(kept, "background")

    out, missing, start, empty, width = None, n, 0, 0, candidates
    while missing > 0 and empty < barren and room:
        found = qualified(start, width)
        count = found.count()
        if count > missing:
            order = uniform(F.col("point_id"), seed, 3)
            found = global_positions(found, [order, F.col("point_id")]).filter(F.col("position") < missing).drop("position")
        out = found if out is None else out.unionByName(found)
        missing, start, empty = missing - min(count, missing), start + width, 0 if count else empty + 1
        if count and 10 * count < missing:
            width = min(2 * width, 64 * candidates)
    return out if out is not None else spark.createDataFrame([], "point_id long, lat double, lon double")


def points_in_polygons(polygons: DataFrame, step: float, per_polygon: int = 250, seed: int = 42) -> DataFrame:
    """Grid points inside each polygon, at most ``per_polygon`` of them picked by hash."""
    nodes = grid_nodes_in(polygons, step).withColumn("_draw", uniform(F.col("lat"), F.col("lon"), seed))
    return top_per_group(nodes, ["polygon_id"], [F.col("_draw")], per_polygon, "_rn").drop("_draw", "_rn")


def split_groups(df: DataFrame, group: str, seed: int, share: float = 0.2) -> DataFrame:
    """Adds ``held_out``: whole groups go to the test side, by hash."""
    return df.withColumn("held_out", uniform(F.col(group), seed) < share)


def interleaved_folds(df: DataFrame, year: str, k: int) -> DataFrame:
    """Adds ``fold``: years in order, dealt out one by one."""
    years = df.select(year).distinct()
    place = F.row_number().over(Window.orderBy(year)) - 1  # one row per year
    return df.join(years.withColumn("fold", F.pmod(place, F.lit(k)).cast("int")), year)


def balanced_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Adds ``fold``: groups from the largest to the smallest, dealt out forth and back (0 .. k-1, k-1 .. 0, ...)."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = global_positions(sizes, [F.desc("_n"), F.col(group)], "_at")
    step = F.pmod(F.col("_at"), F.lit(k))
    back = F.pmod(F.floor(F.col("_at") / k), F.lit(2)) == 1
    return df.join(placed.select(group, F.when(back, k - 1 - step).otherwise(step).cast("int").alias("fold")), group)


def training_table(samples: DataFrame, cells: DataFrame, grid: tuple[float, float, float], bands: list[str], required: list[str]) -> DataFrame:
    """Samples with the bands of their cell; rows lacking a required band are dropped."""
    from ridgewater.operators.raster import sample

    return sample(samples, cells, *grid, bands).dropna(subset=required)
