"""Structured Streaming entry to the batch upserts."""
