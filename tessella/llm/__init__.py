"""Operators for preparing training data: near-duplicates, quality, packing, mixing, archives, URL rules."""
