"""Operators of a training-data pipeline: scoring, deduplication, mixing, packing, secrets, search and archives."""
