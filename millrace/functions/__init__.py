"""Column expressions."""

from millrace.functions.money import net_price, total

__all__ = ["net_price", "total"]
