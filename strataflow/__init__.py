"""Bi-temporal graph and table analytics on Spark DataFrames."""
