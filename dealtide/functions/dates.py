"""Calendar arithmetic by date boundary, never by elapsed hours.

Windows and year floors are written as plain ranges on the raw column
(``col >= constant``), not as ``year(col) >= n``, so that they reach the scan as
pushed filters and prune date partitions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_date(as_of: dt.date | None) -> Column:
    """The report date: a fixed day, or today when none is given."""
    return F.current_date() if as_of is None else F.lit(as_of)


def days_between(start: Column, end: Column) -> Column:
    """Calendar days from ``start`` to ``end``; 23:00 to 01:00 the next day is 1."""
    return F.datediff(end, start)


def from_year(column: Column, min_year: int | None) -> Column:
    """True from 1 January of ``min_year`` on; without a floor, always."""
    if min_year is None:
        return F.lit(True)
    return column >= F.lit(dt.date(min_year, 1, 1))


def in_year(column: Column, year: int) -> Column:
    return (column >= F.lit(dt.date(year, 1, 1))) & (column < F.lit(dt.date(year + 1, 1, 1)))


def within_years(column: Column, as_of: dt.date | None, years: int) -> Column:
    """At most ``years`` year boundaries before the report date, and not after it."""
    today = as_of_date(as_of)
    return (column >= F.trunc(F.add_months(today, -12 * years), "year")) & (column <= today)


def within_quarters(column: Column, as_of: dt.date | None, quarters: int) -> Column:
    """At most ``quarters`` quarter boundaries before the report date, and not after it."""
    today = as_of_date(as_of)
    first = F.add_months(F.trunc(today, "quarter"), -3 * quarters)
    return (column >= first.cast("date")) & (column <= today)


def quarter_label(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"))


def quarter_label_of_month(month: Column) -> Column:
    """'Q1' to 'Q4' for a month number given as text; NULL for anything else."""
    number = month.try_cast("int")
    label = F.concat(F.lit("Q"), F.ceil(number / 3).cast("string"))
    return F.when(number.between(1, 12), label)
