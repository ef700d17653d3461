"""Frequency-ranked prefix completion on Spark DataFrames."""
