"""Hypergraph partitioning analytics on Spark DataFrames."""
