"""Incremental ingest by Structured Streaming."""
