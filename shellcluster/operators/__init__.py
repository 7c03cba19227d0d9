"""Clustering operators on DataFrames."""
