"""Metric collection and roll-up on Spark DataFrames."""
