"""Hazard, rainfall-threshold and evacuation analytics on Spark DataFrames."""
