"""Incremental maintenance of lists from streams of changes."""
