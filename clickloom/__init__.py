"""Clickstream and advertising analytics on Spark DataFrames."""
