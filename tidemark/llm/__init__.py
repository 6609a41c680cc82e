"""Operators for training-data pipelines: dedup, filters, packing, sharding and token files."""
