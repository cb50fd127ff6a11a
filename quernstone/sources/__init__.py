"""Readers and writers: Parquet tables, text lists, chunk tables."""
