"""Operators for preparing large-scale training data.

Nothing else in the library imports this subpackage; it can be removed as a
whole.
"""
