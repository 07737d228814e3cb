"""Tabular insight operators for Spark DataFrames."""
