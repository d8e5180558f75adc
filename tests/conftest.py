from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import SparkSession

from millrace.session import launch_settings
from millrace.sources import SCHEMAS

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config(map=launch_settings())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def with_conf(spark):
    """Sets SQL settings for one test and puts the old ones back."""
    before: dict[str, str | None] = {}

    def change(**settings: str) -> None:
        for key, value in settings.items():
            key = "spark.sql." + key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture(scope="session")
def duck():
    """``duck(scale, sql)``: the rows DuckDB gives on the tables of that scale."""

    def rows(scale: str, sql: str) -> tuple[list[str], list[tuple]]:
        with duckdb.connect() as connection:
            for name in SCHEMAS:
                connection.execute(
                    f"CREATE VIEW {name} AS "
                    f"SELECT * FROM '{TESTDATA}/sf{scale}/{name}.parquet'"
                )
            result = connection.sql(sql)
            return result.columns, sorted(result.fetchall())

    return rows
