"""Training-data operators: fingerprints, filters, mixing, tokenising, archives.

Nothing else in the library imports this subpackage.
"""
