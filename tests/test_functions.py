"""The shared expressions against plain Python."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from dealtide.functions.dates import (
    quarter_label_of_month,
    within_quarters,
    within_years,
)
from dealtide.functions.exact import percent, rounded_ratio, rounded_units
from dealtide.plans.trim import trim_outliers


def half_away(a: int, b: int, places: int) -> float | None:
    if b == 0:
        return None
    exact = Fraction(abs(a) * 10**places, b)
    units = int(exact + Fraction(1, 2))
    return (-units if a < 0 else units) / 10**places


def test_ratios_round_half_away_from_zero(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(-5000, 5000), rng.randint(0, 200)) for _ in range(3000)]
    pairs += [(1005, 1000), (-1, 8), (1, 8), (25, 10), (-25, 10), (10**14 + 5, 10), (0, 5)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select(
        "a",
        "b",
        rounded_ratio("a", "b", 1).alias("one"),
        rounded_ratio("a", "b", 2).alias("two"),
        rounded_units("a", "b", 0).alias("none"),
        percent("a", "b").alias("percent"),
    )
    for r in df.collect():
        assert r.one == half_away(r.a, r.b, 1), r
        assert r.two == half_away(r.a, r.b, 2), r
        assert r.none == half_away(r.a, r.b, 0), r
        share = half_away(r.a * 100, r.b, 1) if r.a else None
        assert r.percent == share, r


def test_ratio_of_huge_totals_does_not_overflow(spark):
    a, b = Decimal(10) ** 27 * 2, Decimal(10) ** 18 * 3
    df = spark.createDataFrame([(a, b)], "a decimal(34,0), b decimal(19,0)")
    row = df.select(rounded_ratio("a", "b", 1).alias("x")).first()
    assert row.x == float((a / b).quantize(Decimal("0.1"), ROUND_HALF_UP))


@pytest.mark.parametrize(
    "as_of", [dt.date(2021, 1, 1), dt.date(2021, 3, 31), dt.date(2020, 2, 29), dt.date(2021, 12, 31)]
)
def test_windows_follow_the_calendar(spark, as_of):
    days = spark.sql(
        "SELECT explode(sequence(date'2017-01-01', date'2023-12-31', interval 1 day)) AS d"
    )
    rows = days.select(
        "d",
        within_quarters(F.col("d"), as_of, 3).alias("quarters"),
        within_years(F.col("d"), as_of, 2).alias("years"),
    ).collect()

    def quarter(d):
        return d.year * 4 + (d.month - 1) // 3

    for r in rows:
        assert r.quarters == (r.d <= as_of and quarter(as_of) - quarter(r.d) <= 3), r
        assert r.years == (r.d <= as_of and as_of.year - r.d.year <= 2), r


def test_month_text_to_quarter(spark):
    months = ["1", "3", "4", "06", "9", "10", "12", "13", "0", "x", "", None]
    df = spark.createDataFrame([(m,) for m in months], "m string")
    got = [r.q for r in df.select(quarter_label_of_month(F.col("m")).alias("q")).collect()]
    assert got == ["Q1", "Q1", "Q2", "Q2", "Q3", "Q4", "Q4", None, None, None, None, None]


def test_trimming_equals_sample_deviation_over_single_values(spark):
    rng = random.Random(3)
    values = [int(rng.gauss(100, 20)) for _ in range(2000)] + [400, -200, 161, 39]
    single = spark.createDataFrame([(v,) for v in values], "v int")
    low, high = single.selectExpr(
        "avg(v) - 3 * stddev_samp(v)", "avg(v) + 3 * stddev_samp(v)"
    ).first()
    histogram = single.groupBy("v").agg(F.count("*").alias("n"))
    kept = trim_outliers(histogram, "v", "n")
    assert kept.columns == ["v", "n"]
    assert {r.v: r.n for r in kept.collect()} == {
        v: values.count(v) for v in values if low <= v <= high
    }
