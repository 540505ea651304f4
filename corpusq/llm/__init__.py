"""Operators for preparing training data at scale, one module each.

Nothing outside this package imports it.  ``registry`` names the queries.
"""
