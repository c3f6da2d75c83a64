"""Leveled-table engine and single-table programs on Spark DataFrames."""
