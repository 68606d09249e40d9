"""Structured Streaming variants: incremental delivery, deduplication, windows and retry state."""
