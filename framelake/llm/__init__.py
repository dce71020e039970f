"""Training-data operators: deduplication, filtering, mixing, packing and search over text corpora.

Nothing else in the library imports this package.
"""
