"""Narrowing customers and orders before they meet the line items."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def customers_in_region(
    customer: DataFrame, nation: DataFrame, region: DataFrame, region_name: str
) -> DataFrame:
    """``c_custkey, n_name`` of the customers whose nation lies in the region.

    The region is a semi join: Spark then estimates the nations of the region at
    no more than the nation table, and its own size check lets it broadcast them.
    As an inner join they would be put at nation times region, and a large
    customer table could be shuffled on 25 nation keys instead.
    """
    wanted = region.filter(F.col("r_name") == region_name)
    nations = nation.join(
        wanted, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"
    )
    return customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_name"
    )


def orders_between(orders: DataFrame, start: date, end: date) -> DataFrame:
    """``o_orderkey, o_custkey`` of the orders dated in ``[start, end)``.

    The bounds are time-zone-free literals, so they reach the Parquet scan and do
    not move with the session's time zone.
    """
    day = F.col("o_orderdate")
    return orders.filter(
        (day >= F.lit(start.isoformat()).cast("timestamp_ntz"))
        & (day < F.lit(end.isoformat()).cast("timestamp_ntz"))
    ).select("o_orderkey", "o_custkey")
