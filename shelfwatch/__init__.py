"""Catalog-change analytics on Spark DataFrames."""
