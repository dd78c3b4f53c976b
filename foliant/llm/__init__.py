"""Operators for preparing text corpora at scale. Nothing else in the library imports this."""
