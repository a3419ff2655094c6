"""Incremental forms of operators over Structured Streaming."""
