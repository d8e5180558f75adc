from __future__ import annotations

import pytest

from millrace.registry import nation_revenue
from millrace.session import GIB, MIB, SETTINGS, configure, launch_settings
from millrace.session import scan_task_bytes, shuffle_partitions
from tests.conftest import TESTDATA

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SCAN = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def bare(spark):
    """A session of its own, without a number of shuffle partitions."""
    session = spark.newSession()
    session.conf.unset("spark.sql.shuffle.partitions")
    return session


def test_sets_what_is_unset(bare):
    configure(bare)
    assert {key: bare.conf.get(key) for key in SETTINGS} == SETTINGS
    assert bare.conf.get(INITIAL) == "200"
    assert bare.conf.get(SCAN, None) is None


def test_keeps_what_is_set(bare):
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    bare.conf.set(key, "3m")
    bare.conf.set("spark.sql.shuffle.partitions", "17")
    bare.conf.set(SCAN, "32m")
    configure(bare, input_bytes=10**14)
    assert bare.conf.get(key) == "3m"
    assert bare.conf.get(SCAN) == "32m"
    assert bare.conf.get(INITIAL, None) is None


def test_sizes_for_a_large_input(bare):
    configure(bare, input_bytes=10**14)
    assert bare.conf.get(INITIAL) == "46567"
    assert bare.conf.get(SCAN) == str(10**9)
    configure(bare)
    assert bare.conf.get(INITIAL) == "46567"


def test_same_rows_from_as_many_partitions_as_a_large_input_gets(spark, bare):
    directory = f"{TESTDATA}/sf0.01"
    expected = sorted(map(tuple, nation_revenue(spark, directory).collect()))
    bare.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    bare.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    configure(bare, input_bytes=10**14)
    frame = nation_revenue(bare, directory)
    assert sorted(map(tuple, frame.collect())) == expected
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 46567)" in plan


def test_partitions_follow_cores_and_size():
    assert shuffle_partitions(8, 0) == 200
    assert shuffle_partitions(8_000, 10**12) == 24_000
    assert shuffle_partitions(8, 1_000 * GIB) == 500


def test_scan_tasks_stay_within_bounds():
    assert scan_task_bytes(10**9) == 128 * MIB
    assert scan_task_bytes(5 * 10**13) == 5 * 10**8
    assert scan_task_bytes(10**16) == GIB
