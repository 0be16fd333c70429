"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
thin registered queries, the other modules the operators themselves.
"""
