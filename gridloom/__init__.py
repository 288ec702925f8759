"""Spatial and temporal analytics over Spark DataFrames."""
