"""Training-data operators: near-duplicates, decontamination, counting, packing, search and placement.

Nothing outside this subpackage imports it.
"""
