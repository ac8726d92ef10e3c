"""Operators for large training-data pipelines over documents and web pages.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
