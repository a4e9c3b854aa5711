"""Operators of a training-data pipeline: quality, duplicates, mixing, tokens, chat text and search."""
