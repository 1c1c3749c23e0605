"""Incremental ingest and log monitoring on Structured Streaming."""
