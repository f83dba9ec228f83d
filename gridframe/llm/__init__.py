"""Operators for building training corpora: mixing, scoring, near-duplicate
removal, extraction, search, sharding, tokenised storage and packing.

Nothing else in the library imports this subpackage.
"""
