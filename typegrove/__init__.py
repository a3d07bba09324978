"""Typed property graphs on Spark DataFrames."""
