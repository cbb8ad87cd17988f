"""Skeinwork: catalog resolution and corpus preparation on Spark DataFrames."""
