"""The plan on small hand-made tables, against brute force in Python."""

from __future__ import annotations

from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.plans import nation_revenue

REGION = [(0, "NORTH"), (1, "SOUTH")]
NATION = [(0, "A", 0), (1, "B", 0), (2, "C", 1), (3, "D", 0)]
START, END = date(2000, 1, 1), date(2001, 1, 1)
LAST_MOMENT = datetime(2000, 12, 31, 23, 59, 59, 999999)


def run(spark, customer, orders, lineitem, region_name="NORTH"):
    frame = nation_revenue(
        spark.createDataFrame(
            lineitem,
            "l_orderkey bigint, l_extendedprice double, l_discount double",
        ),
        spark.createDataFrame(
            orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"
        ),
        spark.createDataFrame(customer, "c_custkey bigint, c_nationkey int"),
        spark.createDataFrame(
            NATION, "n_nationkey int, n_name string, n_regionkey int"
        ),
        spark.createDataFrame(REGION, "r_regionkey int, r_name string"),
        region_name=region_name,
        start=START,
        end=END,
    )
    return {row.n_name: (row.revenue, row.n_lines) for row in frame.collect()}


def brute_force(customer, orders, lineitem, region_name="NORTH"):
    regions = {key for key, name in REGION if name == region_name}
    names = {key: name for key, name, region in NATION if region in regions}
    totals = defaultdict(lambda: [Decimal(0), 0])
    for order, price, discount in lineitem:
        for key, buyer, day in orders:
            if key != order or not START <= day.date() < END:
                continue
            for custkey, nation in customer:
                if custkey == buyer and nation in names:
                    entry = totals[names[nation]]
                    entry[0] += Decimal(str(price)) * (1 - Decimal(str(discount)))
                    entry[1] += 1
    return {name: (total, lines) for name, (total, lines) in totals.items()}


CUSTOMER = [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_bounds_of_the_period(spark):
    orders = [
        (1, 1, datetime(1999, 12, 31, 23, 59, 59, 999999)),
        (2, 1, datetime(2000, 1, 1)),
        (3, 1, LAST_MOMENT),
        (4, 1, datetime(2001, 1, 1)),
    ]
    lines = [(key, 10.0**key, 0.0) for key in (1, 2, 3, 4)]
    assert run(spark, CUSTOMER, orders, lines) == {"A": (Decimal("1100.0000"), 2)}


@pytest.mark.parametrize("zone", ["Pacific/Kiritimati", "Pacific/Pago_Pago"])
def test_session_time_zone_does_not_move_the_bounds(spark, with_conf, zone):
    with_conf(session__timeZone=zone)
    test_bounds_of_the_period(spark)


def test_equal_lines_all_count(spark):
    orders = [(1, 1, datetime(2000, 5, 5))]
    lines = [(1, 19.99, 0.07)] * 3
    assert run(spark, CUSTOMER, orders, lines) == {"A": (Decimal("55.7721"), 3)}


def test_other_region_and_unmatched_rows_stay_out(spark):
    day = datetime(2000, 5, 5)
    # Customer 3 lives elsewhere, customer 9 and order 8 do not exist.
    orders = [(1, 1, day), (2, 3, day), (3, 9, day), (4, 2, day)]
    lines = [(1, 5.0, 0.0), (2, 7.0, 0.0), (3, 9.0, 0.0), (8, 11.0, 0.0)]
    assert run(spark, CUSTOMER, orders, lines) == {"A": (Decimal("5.0000"), 1)}
    assert run(spark, CUSTOMER, orders, lines, "SOUTH") == {"C": (Decimal("7.0000"), 1)}
    assert run(spark, CUSTOMER, orders, lines, "WEST") == {}


def test_null_keys_match_nothing_and_null_amounts_add_nothing(spark):
    day = datetime(2000, 5, 5)
    orders = [(1, 1, day), (None, 1, day), (2, None, day), (3, 1, None)]
    lines = [(None, 1.0, 0.0), (1, None, 0.0), (1, 4.0, 0.5), (2, 1.0, 0.0)]
    lines += [(3, 8.0, 0.0)]
    customer = [*CUSTOMER, (None, 0), (5, None)]
    assert run(spark, customer, orders, lines) == {"A": (Decimal("2.0000"), 2)}


days = st.integers(-200, 560).map(lambda n: datetime(2000, 1, 1) + timedelta(days=n))
lines_ = st.lists(
    st.tuples(
        st.integers(0, 12),
        st.integers(-(10**7), 10**7).map(lambda cents: cents / 100),
        st.integers(0, 100).map(lambda percent: percent / 100),
    ),
    min_size=1,
    max_size=60,
)


@settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    nations=st.lists(st.integers(0, 3), min_size=1, max_size=8),
    bought=st.lists(st.tuples(st.integers(0, 9), days), min_size=1, max_size=10),
    lines=lines_,
)
def test_equals_brute_force(spark, nations, bought, lines):
    customer = list(enumerate(nations))
    orders = [(key, buyer, day) for key, (buyer, day) in enumerate(bought)]
    assert run(spark, customer, orders, lines) == brute_force(customer, orders, lines)
