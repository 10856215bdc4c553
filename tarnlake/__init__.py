"""Semantic table search over data lakes, on PySpark DataFrames."""
