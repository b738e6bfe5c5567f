"""Structured Streaming forms of the incremental index."""
