"""Runs the registered queries on enlarged, skewed copies of the given tables.

    python scale_check.py make OUT [COPIES]    write the enlarged tables to OUT
    python scale_check.py run OUT [BYTES]      run queries and SQL on them, compare

``make`` repeats the tables under new keys, then gives a third of the orders to one
customer, a third of the line items to one order and a tenth to another. ``run`` sizes
the session with ``configure``, for BYTES of input or those that are there, so it can
have as many partitions as a far larger input. It executes each query twice, and its
SQL, written as plain joins, twice in the same Spark with default settings; both must
give the same rows. It prints the time of the second run, what was shuffled, the
longest task, how many joins were split, and where Spark's event log is. It works on
one machine.
"""

from __future__ import annotations

import collections
import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import ORACLE_SQL, QUERIES
from millrace.session import configure, launch_settings
from millrace.sources import SCHEMAS, read_table

SOURCE = "/root/testdata/sf0.1"
FILES = 64
CUSTOMER_STRIDE = 100_000
ORDER_STRIDE = 1_000_000


def session(**settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("scale_check")
        .config("spark.driver.memory", "10g")
        .config(map=launch_settings())
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_of_30(*columns: str):
    """0 to 29, by a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(30))


def make(out: str, copies: int) -> None:
    spark = session()
    tables = {name: read_table(spark, SOURCE, name) for name in SCHEMAS}

    def repeated(name: str) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        return tables[name].repartition(FILES).withColumn("copy", numbers)

    first, second = (
        tables["orders"]
        .filter(F.year("o_orderdate") == 1996)
        .join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .filter("r_name = 'ASIA'")
        .orderBy("o_orderkey")
        .select("o_orderkey", "o_custkey")
        .take(2)
    )
    customer_shift = F.col("copy") * CUSTOMER_STRIDE
    order_shift = F.col("copy") * ORDER_STRIDE
    hot_customer = (share_of_30("o_orderkey", "copy") < 10) & ~F.col("o_orderkey").isin(
        first.o_orderkey, second.o_orderkey
    )
    line_share = share_of_30("l_orderkey", "l_partkey", "l_extendedprice", "copy")
    enlarged = {
        "region": tables["region"],
        "nation": tables["nation"],
        "customer": repeated("customer").withColumn(
            "c_custkey", F.col("c_custkey") + customer_shift
        ),
        "orders": repeated("orders")
        .withColumn(
            "o_custkey",
            F.when(hot_customer, first.o_custkey).otherwise(
                F.col("o_custkey") + customer_shift
            ),
        )
        .withColumn("o_orderkey", F.col("o_orderkey") + order_shift),
        "lineitem": repeated("lineitem")
        .withColumn(
            "l_orderkey",
            F.when(line_share < 10, first.o_orderkey)
            .when(line_share < 13, second.o_orderkey)
            .otherwise(F.col("l_orderkey") + order_shift),
        )
        # Copies differ in price, so that they do not compress to nothing.
        .withColumn(
            "l_extendedprice",
            F.round(F.col("l_extendedprice") + F.col("copy") * 3.17, 2),
        ),
    }
    for name, frame in enlarged.items():
        frame.drop("copy").write.parquet(f"{out}/{name}.parquet")
    spark.stop()


def task_totals(log_folder: str) -> dict[str, collections.Counter]:
    """Per label, from the event log: shuffled MB, CPU seconds, longest task."""
    labels: dict[int, str] = {}
    totals: dict[str, collections.Counter] = collections.defaultdict(
        collections.Counter
    )
    for name in os.listdir(log_folder):
        with open(os.path.join(log_folder, name), encoding="utf-8") as log:
            for event in map(json.loads, log):
                if event["Event"] == "SparkListenerStageSubmitted":
                    label = event["Properties"].get("spark.job.description", "")
                    labels[event["Stage Info"]["Stage ID"]] = label
                elif event["Event"] == "SparkListenerTaskEnd":
                    task = event["Task Metrics"]
                    total = totals[labels[event["Stage ID"]]]
                    written = task["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                    total["shuffled_mb"] += written / 1e6
                    total["cpu_s"] += task["Executor CPU Time"] / 1e9
                    ran = task["Executor Run Time"] / 1e3
                    total["longest_task_s"] = max(total["longest_task_s"], ran)
    return totals


def run(out: str, input_bytes: int = 0) -> None:
    logs = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = session(
        spark__eventLog__enabled="true",
        spark__eventLog__dir=logs,
        spark__eventLog__compress="false",
        spark__eventLog__rolling__enabled="false",
    )
    plain = spark.newSession()
    there = sum(p.stat().st_size for p in Path(out).rglob("*.parquet") if p.is_file())
    configure(spark, input_bytes=input_bytes or there)
    for name in SCHEMAS:
        read_table(plain, out, name).createOrReplaceTempView(name)
    seconds, rows, splits = {}, {}, {}
    for name in QUERIES:
        ways = {
            f"{name} query": lambda: QUERIES[name](spark, out),
            f"{name} sql": lambda: plain.sql(ORACLE_SQL[name]),
        }
        for label, way in ways.items():
            for label_of_run in (f"{label} first", label):
                spark.sparkContext.setJobDescription(label_of_run)
                begin = time.perf_counter()
                frame = way()
                rows[label] = sorted(map(tuple, frame.collect()))
                seconds[label] = round(time.perf_counter() - begin, 1)
                plan = frame._jdf.queryExecution().executedPlan().toString()
                splits[label] = plan.split("== Initial Plan ==")[0].count("skew=true")
    spark.stop()
    totals = task_totals(logs)
    for name in QUERIES:
        query, sql = f"{name} query", f"{name} sql"
        result = {
            "name": name,
            "rows": len(rows[query]),
            "equal": rows[query] == rows[sql],
        }
        for way, label in (("query", query), ("sql", sql)):
            figures = {key: round(value, 1) for key, value in totals[label].items()}
            result[way] = {"seconds": seconds[label], "split": splits[label], **figures}
        print(json.dumps(result))
    print(f"event log: {logs}")


if __name__ == "__main__":
    match sys.argv[1:]:
        case ["make", out]:
            make(out, 100)
        case ["make", out, copies]:
            make(out, int(copies))
        case ["run", out]:
            run(out)
        case ["run", out, input_bytes]:
            run(out, int(float(input_bytes)))
        case _:
            sys.exit(__doc__)
