"""Queries over the given tables, each with the SQL that checks it."""

from workload import files, packs, changes  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
