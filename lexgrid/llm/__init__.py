"""Training-data operators: tokens, privacy, quality, packing, filters, mixing and duplicates.

Nothing else in lexgrid imports this subpackage.
"""
