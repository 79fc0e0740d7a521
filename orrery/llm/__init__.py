"""Training-data operators: deduplication, filtering, scoring, search, mixing and packing.

Nothing outside this subpackage imports it.
"""
