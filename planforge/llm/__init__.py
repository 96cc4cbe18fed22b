"""Training-data operators (deduplication, filtering, mixing, sharding).

Nothing else in the library imports this subpackage.
"""
