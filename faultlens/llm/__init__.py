"""Operators for preparing training text: deduplication, filters, shards and packing."""
