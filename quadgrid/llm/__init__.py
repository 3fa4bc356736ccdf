"""Training-data operators: deduplication, language ID, packing, archives and the like.

Nothing else in quadgrid imports this package.
"""
