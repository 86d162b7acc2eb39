"""Delivery analytics on Spark DataFrames."""
