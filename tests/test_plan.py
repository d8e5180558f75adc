"""What Spark makes of the query: scans, shuffles, broadcasts and skew."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.plans import nation_revenue
from millrace.registry import nation_revenue as registered
from millrace.sources import SCHEMAS, read_table
from tests.conftest import TESTDATA

SMALL = f"{TESTDATA}/sf0.01"
LARGE = f"{TESTDATA}/sf0.1"


def tables_at(spark, directory):
    return {name: read_table(spark, directory, name) for name in SCHEMAS}


def revenue_of(tables):
    return nation_revenue(
        **tables, region_name="ASIA", start=date(1996, 1, 1), end=date(1997, 1, 1)
    )


def planned(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame) -> str:
    """The plan that adaptive execution ended with, after the frame has run."""
    return planned(frame).split("== Initial Plan ==")[0]


@pytest.fixture
def at_scale(with_conf):
    """Thresholds lowered as far as the test tables are smaller than real ones."""
    with_conf(
        autoBroadcastJoinThreshold="16k",
        adaptive__autoBroadcastJoinThreshold="16k",
        adaptive__advisoryPartitionSizeInBytes="16k",
        adaptive__maxShuffledHashJoinLocalMapThreshold="1m",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="32k",
    )


def test_filters_and_columns_reach_the_scans(spark):
    scans = {
        re.search(r"(\w+)\.parquet\]", line).group(1): line
        for line in planned(registered(spark, SMALL)).splitlines()
        if "FileScan" in line
    }
    columns = {
        name: re.search(r"ReadSchema: struct<(.*)>", line).group(1)
        for name, line in scans.items()
    }
    assert columns == {
        "lineitem": "l_orderkey:bigint,l_extendedprice:double,l_discount:double",
        "orders": "o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz",
        "customer": "c_custkey:bigint,c_nationkey:int",
        "nation": "n_nationkey:int,n_name:string,n_regionkey:int",
        "region": "r_regionkey:int,r_name:string",
    }
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in scans["orders"]
    assert "LessThan(o_orderdate,1" in scans["orders"]
    assert "EqualTo(r_name,ASIA)" in scans["region"]
    # Rows without a key, however many, do not reach a shuffle.
    assert "[IsNotNull(l_orderkey)]" in scans["lineitem"]
    assert "isnotnull(o_custkey" in planned(registered(spark, SMALL))


def test_only_nations_and_regions_are_broadcast_at_scale(spark, at_scale):
    frame = revenue_of(tables_at(spark, SMALL))
    plan = planned(frame)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("BroadcastExchange") == 2
    # Line items once, orders twice (by customer, then by order), customers once,
    # and the partial sums.
    assert plan.count("Exchange hashpartitioning") == 5
    assert plan.count("hashpartitioning(l_orderkey") == 1
    assert "hashpartitioning(c_nationkey" not in plan
    assert plan.count("partial_sum") == 1


def test_line_items_cross_the_shuffle_as_key_and_amount(spark, at_scale):
    plan = planned(revenue_of(tables_at(spark, SMALL))).splitlines()
    shuffle = next(i for i, s in enumerate(plan) if "hashpartitioning(l_orderkey" in s)
    projected = re.search(r"Project \[(.*)\]", plan[shuffle + 1]).group(1)
    assert projected.startswith("l_orderkey#")
    assert projected.endswith("AS net_units#" + projected.rsplit("#", 1)[1])
    assert projected.count(" AS ") == 1


def test_same_result_however_the_joins_are_done(spark, with_conf):
    def rows():
        return sorted(map(tuple, revenue_of(tables_at(spark, SMALL)).collect()))

    expected = rows()
    with_conf(autoBroadcastJoinThreshold="-1")
    with_conf(adaptive__autoBroadcastJoinThreshold="-1")
    assert rows() == expected
    with_conf(adaptive__maxShuffledHashJoinLocalMapThreshold="0")
    assert rows() == expected
    with_conf(adaptive__enabled="false")
    assert rows() == expected
    with_conf(ansi__enabled="false", codegen__wholeStage="false")
    assert rows() == expected


def test_large_joins_hash_a_measured_side(spark, at_scale):
    frame = revenue_of(tables_at(spark, LARGE))
    frame.collect()
    plan = final_plan(frame)
    assert plan.count("ShuffledHashJoin") == 2
    assert "SortMergeJoin" not in plan


def test_a_side_too_large_to_hash_is_sorted(spark, at_scale, with_conf):
    with_conf(adaptive__maxShuffledHashJoinLocalMapThreshold="0")
    frame = revenue_of(tables_at(spark, LARGE))
    frame.collect()
    assert final_plan(frame).count("SortMergeJoin") == 2


@pytest.mark.parametrize("partitions", ["8", "2100"])
@pytest.mark.parametrize("hashed", ["1m", "0"])
def test_hot_order_and_customer_are_split(
    spark, duck, at_scale, with_conf, hashed, partitions
):
    """A third of the orders is one customer's, a third of the lines one order's.

    Beyond 2,000 partitions Spark keeps exact block sizes only as the launch settings
    ask for.
    """
    with_conf(
        adaptive__maxShuffledHashJoinLocalMapThreshold=hashed,
        shuffle__partitions=partitions,
    )
    tables = tables_at(spark, LARGE)
    hot_customer, hot_order = duck(
        "0.1",
        """SELECT MIN(o_custkey), MIN(o_orderkey) FROM orders
           WHERE o_custkey = (SELECT MIN(c_custkey) FROM customer
                              JOIN nation ON c_nationkey = n_nationkey
                              JOIN region ON n_regionkey = r_regionkey
                              JOIN orders ON o_custkey = c_custkey
                              WHERE r_name = 'ASIA' AND year(o_orderdate) = 1996)
             AND year(o_orderdate) = 1996""",
    )[1][0]
    # Each test table is one row group, so one task would write all of its shuffle.
    tables["orders"] = tables["orders"].repartition(16).withColumn(
        "o_custkey",
        F.when(F.col("o_orderkey") % 3 == 0, hot_customer).otherwise(
            F.col("o_custkey")
        ),
    )
    tables["lineitem"] = tables["lineitem"].repartition(16).withColumn(
        "l_orderkey",
        F.when(F.col("l_partkey") % 3 == 0, hot_order).otherwise(F.col("l_orderkey")),
    )
    frame = revenue_of(tables)
    got = sorted((row[0], float(row[1]), row[2]) for row in frame.collect())
    expected = duck(
        "0.1",
        f"""WITH l AS (SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN {hot_order}
                                              ELSE l_orderkey END AS l_orderkey)
                       FROM lineitem),
                 o AS (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0
                                              THEN {hot_customer}
                                              ELSE o_custkey END AS o_custkey)
                       FROM orders)
            SELECT n_name,
                   CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))
                            * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS DOUBLE),
                   COUNT(*)
            FROM l JOIN o ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey
            WHERE r_name = 'ASIA' AND year(o_orderdate) = 1996
            GROUP BY n_name""",
    )[1]
    assert got == expected
    assert final_plan(frame).count("Join(skew=true)") == 2


def test_a_table_may_be_a_folder_of_files(spark, duck, tmp_path):
    for name in SCHEMAS:
        read_table(spark, SMALL, name).repartition(3).write.parquet(
            f"{tmp_path}/{name}.parquet"
        )
    assert sorted(map(tuple, registered(spark, str(tmp_path)).collect())) == sorted(
        map(tuple, registered(spark, SMALL).collect())
    )


@pytest.mark.parametrize(
    "table, column",
    [("lineitem", "l_orderkey"), ("lineitem", "l_discount"), ("orders", "o_orderdate")],
)
def test_a_missing_column_is_an_error(spark, tmp_path, table, column):
    for name in SCHEMAS:
        frame = read_table(spark, f"{TESTDATA}/sf0.001", name)
        frame = frame.drop(column) if name == table else frame
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    with pytest.raises(ValueError, match=f"{table}.*{column}.*missing"):
        registered(spark, str(tmp_path))


def test_a_column_of_another_type_is_an_error(spark, tmp_path):
    frame = read_table(spark, f"{TESTDATA}/sf0.001", "orders")
    frame.withColumn("o_custkey", F.col("o_custkey").cast("string")).write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    with pytest.raises(ValueError, match="orders.*o_custkey.*string.*bigint"):
        read_table(spark, str(tmp_path), "orders")


def test_more_columns_may_be_there(spark, tmp_path):
    frame = read_table(spark, f"{TESTDATA}/sf0.001", "region")
    frame.withColumn("more", F.lit(1)).write.parquet(f"{tmp_path}/region.parquet")
    assert read_table(spark, str(tmp_path), "region").columns == frame.columns


def test_declared_schemas_are_those_of_the_files(spark):
    for name in SCHEMAS:
        path = f"{SMALL}/{name}.parquet"
        assert read_table(spark, SMALL, name).schema == spark.read.parquet(path).schema
