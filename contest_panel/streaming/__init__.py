"""Structured Streaming counterparts of the batch plans."""
