"""Distributed geometry operators over DataFrames."""
