"""Uplift ranking and collective-action analytics on Spark DataFrames."""
