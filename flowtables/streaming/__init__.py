"""Structured Streaming forms of upsert, deduplication and rolling windows."""
