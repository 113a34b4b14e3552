"""Operators for large training-text corpora: mixing, sharding, media, scans, quality, search, tokens and duplicates.

Nothing else in the library imports this subpackage.
"""
