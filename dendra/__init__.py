"""Hierarchical density clustering and corpus processing on Spark DataFrames."""
