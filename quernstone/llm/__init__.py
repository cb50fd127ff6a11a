"""Corpus-preparation operators: ten stages of a training-data pipeline.

Nothing outside this subpackage imports it.
"""
