"""Structured Streaming entry points that reuse the batch operators."""
