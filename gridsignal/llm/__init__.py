"""Operators for training-data pipelines: mixing, deduplication, packing, extraction, search, scoring and archives."""
