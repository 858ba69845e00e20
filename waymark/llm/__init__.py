"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and their SQL.
"""
