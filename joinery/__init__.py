"""Partitioned equi-join analytics on Spark DataFrames."""
