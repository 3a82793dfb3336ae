"""Operators for preparing text and code as training data.

Nothing outside this subpackage imports it.
"""
