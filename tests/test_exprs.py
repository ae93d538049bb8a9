import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import exprs


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_round_matches_binary_rounding(spark, digits):
    rng = random.Random(digits)
    values = [1.005, 0.285, 2.5, -2.5, 0.125, -0.004, 0.0, 1e15, None]
    values += [rng.uniform(-1000, 1000) for _ in range(500)] + [rng.randrange(10_000) / 1000 for _ in range(500)]
    con = duckdb.connect()
    expected = [None if v is None else con.execute(f"select round(?::double, {digits})", [v]).fetchone()[0] for v in values]
    assert column(spark, values, lambda x: exprs.round_to(x, digits)) == expected


def test_round_leaves_values_without_a_fraction_alone(spark):
    values = [9.9e17, -4.5e300, 2.0**60]
    assert column(spark, values, lambda x: exprs.round_to(x, 4)) == values


def test_ratio_over_zero_is_null(spark):
    assert column(spark, [0.0, 4.0], lambda x: exprs.ratio(F.lit(2), x)) == [None, 0.5]


def test_band_edges(spark):
    labels = ("low", "mid", "high")
    values = [9.0, 10.0, 19.0, 20.0, 21.0]
    assert column(spark, values, lambda x: exprs.band(x, (10, 20), labels)) == ["low", "mid", "mid", "high", "high"]
    inclusive = column(spark, values, lambda x: exprs.band(x, (10, 20), labels, inclusive=True))
    assert inclusive == ["low", "low", "mid", "mid", "high"]
    with pytest.raises(ValueError):
        exprs.band(F.col("x"), (1, 2), ("a", "b"))


def test_minutes_count_boundaries(spark):
    df = spark.sql(
        "select timestamp_ntz'2026-01-01 00:00:59' a, timestamp_ntz'2026-01-01 00:01:01' b union all "
        "select timestamp_ntz'1969-12-31 23:59:30', timestamp_ntz'1970-01-01 00:00:10'"
    )
    gaps = df.select(exprs.minute_index(F.col("b")) - exprs.minute_index(F.col("a"))).collect()
    assert [g[0] for g in gaps] == [1, 1]


def test_minutes_do_not_depend_on_the_session_time_zone(spark):
    # 02:30 does not exist in New York on that day.
    df = spark.sql("select timestamp_ntz'2026-03-08 01:59:00' a, timestamp_ntz'2026-03-08 03:01:00' b")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(exprs.minute_index(F.col("b")) - exprs.minute_index(F.col("a"))).first()[0] == 62
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_whole_days(spark):
    df = spark.sql("select timestamp_ntz'2026-01-01 18:00:00' a, timestamp_ntz'2026-01-03 12:00:00' b")
    assert df.select(exprs.whole_days_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_erfc(spark):
    values = [0.0, 0.01, 0.5, 1.0, 1.7, 2.49, 2.5, 3.0, 5.0, 10.0]
    for got, x in zip(column(spark, values, exprs.erfc), values):
        assert got == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize(
    ("x", "dof", "p"),
    [  # textbook 5 % and 1 % points
        (3.841458820694124, 1, 0.05),
        (5.991464547107979, 2, 0.05),
        (7.814727903251179, 3, 0.05),
        (9.487729036781154, 4, 0.05),
        (18.307038053275146, 10, 0.05),
        (15.08627246938899, 5, 0.01),
        (0.0, 0, 1.0),
    ],
)
def test_chi2_tail(spark, x, dof, p):
    assert spark.range(1).select(exprs.chi2_tail(F.lit(x), F.lit(dof))).first()[0] == pytest.approx(p, rel=1e-9)


def test_binomial_tail(spark):
    p = 0.0525
    exact = sum(math.comb(8, k) * p**k * (1 - p) ** (8 - k) for k in range(3, 9))
    assert column(spark, [p], lambda x: exprs.binomial_tail(x, 8, 3))[0] == pytest.approx(exact, rel=1e-9)
