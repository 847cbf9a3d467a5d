"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  ``catalog`` holds the registered
queries and their SQL; every other module is one operator or a shared helper.
"""
