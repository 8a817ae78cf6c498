"""Operators of a training-data pipeline: sharding, tokens, packing, filters, near duplicates, archives."""
