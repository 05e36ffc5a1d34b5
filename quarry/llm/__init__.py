"""Operators of a training-data pipeline: encoding, near duplicates, quality, mixing, sharding, extraction, search, packing."""
