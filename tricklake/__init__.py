"""Duplicate-bridge analytics on Spark DataFrames."""
