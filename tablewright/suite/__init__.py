"""The checked queries: one per operator, with an SQL counterpart where SQL can express it."""

from tablewright.suite import cleaning, models, profiles, relational, tables, transforms  # noqa: F401
from tablewright.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
