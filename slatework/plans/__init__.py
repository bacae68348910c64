"""Requests as values: filters, query specifications and results."""

from slatework.plans.spec import AGGREGATES, MAX_ROWS, Filter, QueryResult, QuerySpec

__all__ = ["AGGREGATES", "MAX_ROWS", "Filter", "QueryResult", "QuerySpec"]
