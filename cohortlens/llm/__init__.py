"""Operators for large-scale training-data preparation.

Each module holds one operator with a general DataFrame interface; ``queries``
registers the thin queries over the given tables.  Nothing outside this
subpackage imports it.
"""
