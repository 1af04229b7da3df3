"""Registered queries of the campaign operators, each with the SQL that checks it."""

from . import binding, efficiency, matching, tables  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
