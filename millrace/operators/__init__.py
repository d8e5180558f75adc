"""Building blocks that take DataFrames and return a DataFrame."""

from millrace.operators.orders import customers_in_region, orders_between

__all__ = ["customers_in_region", "orders_between"]
