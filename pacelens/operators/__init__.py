"""Operators: each takes DataFrames plus parameters and returns a DataFrame."""
