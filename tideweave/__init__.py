"""Temporal graph-stream analytics on Spark DataFrames."""
