"""Registered queries over the provided tables, with the SQL each must agree with."""

from gridloom.queries import catalogue  # noqa: F401
from gridloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
