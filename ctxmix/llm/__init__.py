"""Operators for preparing training text: scoring, near-duplicates, tokens, packing, formatting."""
