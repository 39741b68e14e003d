"""Operators that prepare training data from a text corpus."""
