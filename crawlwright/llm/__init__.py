"""Operators for preparing text and vector corpora at scale.

Nothing else in the library imports this subpackage.
"""
