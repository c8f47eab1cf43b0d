"""Tabular data-quality pipeline on Spark DataFrames."""
