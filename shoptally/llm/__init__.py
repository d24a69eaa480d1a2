"""Operators of a training-data pipeline: filters, duplicates, packing, archives, shards, search."""
