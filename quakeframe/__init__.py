"""Earthquake relocation on Spark DataFrames."""
