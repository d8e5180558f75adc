"""Parquet tables with declared schemas.

A declared schema keeps the types the same whatever a single file's footer says. Spark
reads a declared column that a file lacks as nulls, and the answer shrinks without a
word, so the columns are first compared with those of one footer. That is one small job
per table; other files of a folder are not opened for it.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, "
        "c_acctbal double, c_mktsegment string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` under ``directory``, a file or a folder of part files.

    Raises ValueError, with the table and column, if a declared column is missing from
    the file that is looked at, or has another type there. More columns may be there.
    """
    path = f"{directory}/{name}.parquet"
    there = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    declared = spark.read.schema(SCHEMAS[name]).parquet(path)
    for field in declared.schema:
        found = there.get(field.name)
        if found != field.dataType:
            what = f"is {found.simpleString()}" if found else "is missing"
            raise ValueError(
                f"table {name}, column {field.name}: {what} in {path}, "
                f"declared {field.dataType.simpleString()}"
            )
    return declared


def read_tables(
    spark: SparkSession, directory: str, names: Iterable[str]
) -> dict[str, DataFrame]:
    """Several tables by name; their columns are looked at side by side."""
    names = list(names)
    with ThreadPoolExecutor(max(1, len(names))) as pool:
        frames = pool.map(lambda name: read_table(spark, directory, name), names)
        return dict(zip(names, frames, strict=True))
