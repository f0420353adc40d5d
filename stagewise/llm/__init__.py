"""Training-data operators: filters, deduplication, scans, packing and sharding.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
