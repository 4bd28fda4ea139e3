"""Training-data operators: quality rules, search, sharding, deduplication, mixing, scans and writers.

Nothing outside this subpackage imports it.
"""
