"""Structured Streaming over evaluation and timing logs."""
