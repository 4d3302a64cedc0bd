"""Spatial load analytics on Spark: points, pixels and small graphs as DataFrames keyed by image."""
