"""Operators of a training-data pipeline: deduplication, packing, filtering, formatting."""
