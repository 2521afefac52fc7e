"""Operators for preparing training text: encoding, deduplication, filters, packing, formatting."""
