"""Operators for training-data pipelines: deduplication, filters, tokens, packing and mixing."""
