"""Registered queries and the SQL each one is checked against."""

from loanloom.catalog.base import ORACLES, QUERIES
from loanloom.catalog import evaluation, features, leafwise, models, monitoring, profiles, stumps  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
