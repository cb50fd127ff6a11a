"""Posting-list analytics on Spark: build, look up, merge and encode inverted indexes."""
