"""Training-data operators: WARC assembly, near-dedup, decontamination, sharding, filters, tokenizing.

Nothing else in the library imports this subpackage.
"""
