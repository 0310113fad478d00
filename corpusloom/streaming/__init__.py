"""Incremental forms over Structured Streaming."""
