"""Exact money arithmetic on amounts that are stored as doubles.

Sums of doubles depend on the order in which tasks finish, so amounts are turned
into whole numbers first. A price with two decimals and a discount in hundredths
give a net price that is a whole number of ten-thousandths; it fits a bigint,
which costs one multiplication per row and 8 bytes in a shuffle, where a decimal
cast would build an object per value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_WHOLE = 10_000


def _hundredths(amount: Column) -> Column:
    # Exact for every two-decimal amount below 2**51 hundredths: the error of
    # amount * 100 is then under one half. Other amounts go to the nearest hundredth,
    # halves away from zero, as decimal casts do.
    near = F.floor(F.abs(amount * 100) + 0.5)
    return (F.signum(amount) * near).cast("bigint")


def net_price(price: Column, discount: Column) -> Column:
    """``price * (1 - discount)`` in ten-thousandths, as bigint."""
    return _hundredths(price) * (F.lit(100).cast("bigint") - _hundredths(discount))


def total(units: Column) -> Column:
    """Sum of amounts in ten-thousandths, as ``decimal(38,4)`` in whole units.

    The sum itself is a decimal, since a bigint could overflow over a large table.
    """
    return (F.sum(units.cast("decimal(18,0)")) / UNITS_PER_WHOLE).cast("decimal(38,4)")
