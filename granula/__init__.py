"""Granular density-peak analytics on Spark DataFrames."""
