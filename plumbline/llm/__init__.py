"""Training-data operators: deduplication, filtering, scoring, search, packing, formatting.

Nothing else in the library imports this subpackage.
"""
