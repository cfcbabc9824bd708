"""Operators: each takes and gives DataFrames keyed by document."""
