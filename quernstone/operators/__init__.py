"""Building, looking up, merging and chunking posting lists as DataFrame operations."""
