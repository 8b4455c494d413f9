"""Operators on catalogs: DataFrames in, DataFrames out."""
