"""Raster, feature and learning analytics as Spark DataFrames."""
