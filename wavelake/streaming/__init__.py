"""Structured Streaming over shots."""
