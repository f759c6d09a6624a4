"""Operators: DataFrames in, a DataFrame out, nothing computed before an action."""
