"""Annotated-text analytics on Spark DataFrames."""
