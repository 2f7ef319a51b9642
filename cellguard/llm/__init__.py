"""Operators of a training-data pipeline: scoring, sharding, de-duplication, language ID, archives, packing."""
