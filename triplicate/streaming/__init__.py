"""Structured Streaming counterparts of counters and limits."""
