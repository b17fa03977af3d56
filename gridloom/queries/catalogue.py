"""Loads every module of registered queries."""

from gridloom.queries import (  # noqa: F401
    aggregates,
    cleaning,
    contracts,
    detection,
    domain,
    joining,
    learning,
    ordering,
    reading,
    streams,
)
