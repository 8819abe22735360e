"""Outlier trimming on a histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame


def trim_outliers(histogram: DataFrame, value: str, weight: str, k: float = 3) -> DataFrame:
    """Keep the rows whose value lies within mean +- k sample standard deviations, ends included.

    ``histogram`` has one row per group and distinct ``value``, a number of days, counted by
    ``weight``. Its size is bounded by the calendar and the report groups (practice, year,
    quarter), not by the number of deals, so the window over all of it may run in one task;
    in return the deals and their history are read and shuffled only once, where a join with
    a separate aggregate would do both twice.

    Sums are exact integers, so the cut does not depend on the order of partial sums. A single
    observation has no standard deviation and is dropped.
    """
    trimmed = histogram.selectExpr("*", *moments_sql(value, weight))
    return trimmed.filter(inside_sql(value, k)).drop("_n", "_s1", "_s2")


def moments_sql(value: str, weight: str) -> list[str]:
    v, w = f"cast({value} AS decimal(10,0))", f"cast({weight} AS decimal(18,0))"
    return [
        f"sum({w}) OVER () AS _n",
        f"cast(sum({v} * {w}) OVER () AS decimal(28,0)) AS _s1",
        f"sum({v} * {v} * {w}) OVER () AS _s2",
    ]


def inside_sql(value: str, k: float) -> str:
    """Within k deviations, given the moments."""
    mean = "double(_s1) / double(_n)"
    deviation = "sqrt(double(_n * _s2 - _s1 * _s1) / nullif(double(_n) * double(_n - 1), 0D))"
    return f"{value} BETWEEN {mean} - {k} * {deviation} AND {mean} + {k} * {deviation}"
