"""Registered queries: each library operator run on the driver tables, next to the
SQL that gives the same rows. All of them read whole tables.
"""

from entries.registry import ORACLES, QUERIES
from entries import columns, jobs, joins, profiles, samples, texts  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
