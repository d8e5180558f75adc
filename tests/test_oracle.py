"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from millrace.registry import ORACLE_SQL, QUERIES
from tests.conftest import TESTDATA


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name, scale):
    frame = queries()[name](spark, f"{TESTDATA}/sf{scale}")
    columns, expected = duck(scale, oracle_sql()[name])
    assert frame.columns == columns
    assert expected
    assert sorted(map(tuple, frame.collect())) == expected


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert QUERIES.keys() <= queries().keys()
    assert oracle_sql().keys() <= queries().keys()


def test_entry_has_rows_and_a_fixed_schema(spark):
    frame = entry(spark)
    assert frame.schema.simpleString() == (
        "struct<n_name:string,revenue:double,n_lines:bigint>"
    )
    assert frame.count() == 5
