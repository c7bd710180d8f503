"""Causality analytics and large-table preparation on Spark DataFrames."""
