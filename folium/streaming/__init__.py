"""Incremental runs over Structured Streaming."""
