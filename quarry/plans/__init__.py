"""Queries composed from sources, functions and operators."""

from quarry.plans.revenue_by_priority import (
    ORACLE_SQL as REVENUE_BY_PRIORITY_SQL,
    revenue_by_priority,
    revenue_by_priority_at,
)

__all__ = ["REVENUE_BY_PRIORITY_SQL", "revenue_by_priority", "revenue_by_priority_at"]
