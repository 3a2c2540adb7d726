"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Each module holds one operator with its own general interface.  ``queries``
holds the thin ``opN_`` queries over the driver tables and their SQL.
"""
