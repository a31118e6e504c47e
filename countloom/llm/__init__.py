"""Training-data operators. Nothing else in the library imports this subpackage.

Each module holds one operator with its own general interface; ``catalog`` holds
the thin ``opN_`` queries that apply them to the driver's tables.
"""
