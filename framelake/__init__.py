"""Raster-stream analytics on Spark DataFrames."""
