"""Structured Streaming over growing corpora (an extension)."""
