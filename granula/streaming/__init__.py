"""Incremental results kept by Structured Streaming."""
