from __future__ import annotations

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import net_price, total

# Any price that decimal(12,2) holds, and any discount from none to all.
amounts = st.lists(
    st.tuples(st.integers(-(10**12) + 1, 10**12 - 1), st.integers(0, 100)),
    min_size=1,
    max_size=400,
)


def frame_of(spark, rows):
    return spark.createDataFrame(
        [(cents / 100, percent / 100) for cents, percent in rows],
        "price double, discount double",
    )


@settings(
    max_examples=15,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(rows=amounts)
def test_net_price_and_total_are_exact(spark, rows):
    frame = frame_of(spark, rows).select(
        net_price(F.col("price"), F.col("discount")).alias("units")
    )
    got = [row.units for row in frame.collect()]
    assert got == [cents * (100 - percent) for cents, percent in rows]
    assert frame.agg(total(F.col("units")).alias("t")).first().t == Decimal(
        sum(got)
    ).scaleb(-4)


def test_every_hundredth_up_to_two_million(spark):
    """Against the decimal cast that the SQL uses."""
    wrong = (
        spark.range(-1_000_000, 1_000_001)
        .select((F.col("id") / 100).cast("double").alias("price"))
        .filter(
            F.col("price").cast("decimal(12,2)") * 10_000
            != net_price(F.col("price"), F.lit(0.0))
        )
    )
    assert wrong.count() == 0


def test_halves_of_a_hundredth_go_away_from_zero(spark, duck):
    """As DuckDB's casts do; and Spark's, where binary holds the half exactly."""
    halves = [(k * 10 + 5) / 1000 for k in range(-3000, 3001)]
    halves = [h for h in halves if abs(h) < 9.99]
    frame = spark.createDataFrame([(h,) for h in halves], "x double")
    got = frame.select(
        "x", (net_price(F.col("x"), F.lit(0.0)) / 100).cast("bigint").alias("price"),
        ((100 - net_price(F.lit(1.0), F.col("x")) / 100)).cast("bigint").alias("discount"),
        (F.col("x").cast("decimal(12,2)") * 100).cast("bigint").alias("spark"),
    ).collect()
    values = ", ".join(f"({h!r}::DOUBLE)" for h in halves)
    sql = f"""SELECT x, CAST(CAST(x AS DECIMAL(12,2)) * 100 AS BIGINT),
              CAST(CAST(x AS DECIMAL(3,2)) * 100 AS BIGINT) FROM (VALUES {values}) AS t(x)"""
    expected = {x: (price, discount) for x, price, discount in duck("0.001", sql)[1]}
    assert {r.x: (r.price, r.discount) for r in got} == expected
    exact = [r for r in got if (r.x * 8).is_integer()]
    assert len(exact) > 50
    assert all(r.price == r.spark for r in exact)


def test_total_outgrows_bigint(spark):
    """Line amounts fit a bigint, their sum need not."""
    largest = 10**18 - 1
    frame = spark.range(100).select(F.lit(largest).alias("units"))
    assert frame.agg(total(F.col("units")).alias("t")).first().t == Decimal(
        100 * largest
    ).scaleb(-4)


def test_missing_amounts_are_left_out_of_the_total(spark):
    frame = spark.createDataFrame(
        [(10.0, 0.1), (None, 0.1), (10.0, None)], "price double, discount double"
    )
    units = net_price(F.col("price"), F.col("discount"))
    assert frame.agg(total(units).alias("t")).first().t == Decimal("9.0000")


def test_total_of_no_rows_is_null(spark):
    frame = frame_of(spark, [(1, 0)]).filter("false")
    units = net_price(F.col("price"), F.col("discount"))
    assert frame.agg(total(units).alias("t")).first().t is None
