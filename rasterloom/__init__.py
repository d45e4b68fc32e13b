"""Raster and region-graph analytics on Spark DataFrames, with corpus operators in ``llm``."""
