"""Keyword and content analytics on Spark DataFrames."""
