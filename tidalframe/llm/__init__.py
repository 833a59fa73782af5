"""Training-data operators: filters, near-duplicate joins, mixing, packing and token files.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
