"""Streaming over the growing candidate log."""
