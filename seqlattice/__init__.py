"""Alignment-free sequence similarity on Spark DataFrames."""
