"""Operators for training-data pipelines (deduplication, tokens, filters)."""
