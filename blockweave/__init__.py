"""Typed, dimension-aware columnar encoding and selective scanning on Spark DataFrames."""

__version__ = "0.1.0"
