"""Operators for large training corpora: one module per operator, `queries.py` with the
queries registered for them. Nothing outside this package imports it.
"""
