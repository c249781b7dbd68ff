"""Orders in which lists are shown, as a position column that needs no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewater.operators.scale import global_positions


def zones_list(zones: DataFrame, row_id: str) -> DataFrame:
    """Kind descending, then name."""
    return global_positions(zones, [F.desc("kind"), F.asc("name"), F.asc(row_id)])


def reports_list(reports: DataFrame, row_id: str) -> DataFrame:
    """Newest first."""
    return global_positions(reports, [F.desc("ts"), F.asc(row_id)])


def warnings_list(warnings: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Worst severity first (unknown ones last), then by the text of the expiry."""
    rank: Column = F.lit(max(ranks.values()) + 1)
    for name, value in ranks.items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)
    return global_positions(warnings.withColumn("severity_rank", rank), [F.col("severity_rank"), F.asc("expires"), F.asc("identifier")])


def zone_index(zones: DataFrame, row_id: str) -> DataFrame:
    """Towns first, then by label."""
    return global_positions(zones.withColumn("is_town", F.col("kind") == "town"), [F.desc("is_town"), F.asc("label"), F.asc(row_id)])
