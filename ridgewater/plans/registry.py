"""All registered queries: name -> (function of a session and a table folder, DuckDB SQL or None)."""

from __future__ import annotations

from importlib import import_module

FAMILIES = [
    "alert_plans",
    "calibrate_plans",
    "export_plans",
    "feed_plans",
    "layer_plans",
    "model_plans",
    "outline_plans",
    "rain_plans",
    "raster_plans",
    "road_plans",
    "spatial_plans",
    "stream_plans",
]


def all_queries() -> dict:
    found: dict = {}
    for family in FAMILIES:
        queries = import_module(f"ridgewater.plans.{family}").QUERIES
        repeated = found.keys() & queries.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        found.update(queries)
    return found
