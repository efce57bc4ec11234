"""Queries over the driver's tables, each with an independent SQL form."""

from terralith.plans import audits, files, grouping, lands, maps, rules, scenes, selection, ways  # noqa: F401
from terralith.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
