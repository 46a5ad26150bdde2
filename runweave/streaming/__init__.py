"""Structured Streaming: the same state, kept incrementally."""
