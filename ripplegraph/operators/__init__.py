"""Relational operators of the analysis, each from DataFrames to a DataFrame."""
