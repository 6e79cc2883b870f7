"""Operators for preparing training text, vectors and pages at scale.

Nothing else in the library imports this subpackage.
"""
