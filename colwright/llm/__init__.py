"""Operators for building training data from a corpus of documents; nothing else in the library imports them."""
