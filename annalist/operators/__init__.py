"""Operators: each takes a :class:`annalist.History` (or DataFrames) and returns a DataFrame."""
