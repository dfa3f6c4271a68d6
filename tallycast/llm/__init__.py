"""Operators of a training-data pipeline: sharding, cleaning, deduplication, search, formatting, packing."""
