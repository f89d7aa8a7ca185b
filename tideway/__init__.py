"""Partitioned, keyed, ordered event streams as Spark DataFrames."""
