"""Relational operators of the domain on DataFrames."""
