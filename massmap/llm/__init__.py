"""Operators for preparing training data: quality, deduplication, search, formatting, mixing and packing.

Nothing else in the library imports this subpackage.
"""
