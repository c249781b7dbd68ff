"""Registered queries against their DuckDB text on the smallest tables, and the shape of the registry."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = [
    "zone_status", "nearest_polygon", "radius_join", "trailing_totals", "forecast_outlook", "district_days", "roc_auc",
    "exact_quantile", "rarity_other_years", "event_episodes", "report_lifecycle", "ffpi_bands", "road_edges", "warning_feed",
    "polygon_measures", "best_f1", "alert_messages", "fold_assignment", "fetch_plan", "layer_health", "zones_in_order",
    "covering_polygons", "shelter_clusters", "clipped_squares", "spell_fix_words", "layers_read_back", "sql_functions",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["zone_id", "effective_class"] and df.count() >= 0
