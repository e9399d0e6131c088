"""Mobility-access analytics on Spark DataFrames."""
