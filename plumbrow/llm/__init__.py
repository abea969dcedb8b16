"""Operators of a training-data pipeline: scoring, deduplication, filtering, search, mixing and sharding."""
