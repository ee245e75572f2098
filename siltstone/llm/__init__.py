"""Training-data operators (secrets, packing, near-duplicates, quality, personal data, ...).

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
