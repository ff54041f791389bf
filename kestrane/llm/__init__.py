"""Operators for large training-data pipelines: one module for each, and ``queries`` with their registered queries.

Nothing outside this subpackage imports it.
"""
