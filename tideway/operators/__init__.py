"""Operators over topics: DataFrames in, DataFrames out. The present is always a parameter (now_ms)."""
