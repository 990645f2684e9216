"""Training-data operators: deduplication, filters, scoring, tokenising, packing and media columns.

Nothing else in the library imports this subpackage.
"""
