"""Structured Streaming variants of the stateless stages."""
