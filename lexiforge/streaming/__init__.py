"""Structured Streaming over the same stateless transformations."""
