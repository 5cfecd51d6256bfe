"""Operators that prepare training data: quality, duplicates, packing, formatting, filters."""
