"""Structured Streaming versions of the continuous jobs."""
