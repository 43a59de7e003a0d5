"""Training-data operators: dedup, quality, mixing, packing, search, archives, negatives, vectors, prompts.

Nothing outside this subpackage imports it; removing the folder leaves the
rest of the library intact.
"""
