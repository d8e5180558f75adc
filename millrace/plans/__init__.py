"""Whole queries."""

from millrace.plans.nation_revenue import nation_revenue

__all__ = ["nation_revenue"]
