"""The registered queries and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import nation_revenue as nation_revenue_plan
from millrace.session import configure
from millrace.sources import read_tables


def nation_revenue(spark: SparkSession, directory: str) -> DataFrame:
    """Revenue per nation of ASIA in 1996."""
    configure(spark)
    tables = read_tables(
        spark, directory, ("lineitem", "orders", "customer", "nation", "region")
    )
    exact = nation_revenue_plan(
        **tables, region_name="ASIA", start=date(1996, 1, 1), end=date(1997, 1, 1)
    )
    # Decimals come back from the two engines with different widths; doubles agree.
    return exact.withColumn("revenue", F.col("revenue").cast("double"))


NATION_REVENUE_SQL = """
SELECT n_name,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))
                * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS DOUBLE) AS revenue,
       CAST(COUNT(*) AS BIGINT) AS n_lines
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA'
  AND o_orderdate >= TIMESTAMP '1996-01-01'
  AND o_orderdate < TIMESTAMP '1997-01-01'
GROUP BY n_name
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "nation_revenue": nation_revenue,
}

ORACLE_SQL: dict[str, str] = {
    "nation_revenue": NATION_REVENUE_SQL,
}
