"""Operators over logs: DataFrames in, DataFrames out."""
