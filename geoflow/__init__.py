"""Layers, commands and expressions for tabular and geospatial data on Spark."""
