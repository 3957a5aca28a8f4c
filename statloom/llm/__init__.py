"""Training-data operators: tokenising, search, filters, near-duplicates, mixing and scoring.

Nothing else in the library imports this subpackage; it may be deleted whole.
"""
