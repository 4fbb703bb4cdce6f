"""Operators for large training-data corpora: extraction, scoring, deduplication, search, mixing and packing."""
