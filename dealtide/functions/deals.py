"""Predicates on deals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealtide.functions.dates import days_between

# The data practice, in lower case.
DATA_PRACTICES = ("data", "data (l2)")


def won() -> Column:
    return F.col("is_closed") & F.col("is_won")


def lost() -> Column:
    return F.col("is_closed") & ~F.col("is_won")


def closed_once() -> Column:
    """Closed and not marked as a duplicate of another deal."""
    return F.col("is_closed") & ~F.lower("stage_name").like("%duplicate%")


def in_practices(practices: Sequence[str] | None) -> Column:
    """Practice is one of the given lower-case names; no list means every deal."""
    if practices is None:
        return F.lit(True)
    return F.lower("practice").isin(list(practices))


def created_year() -> Column:
    return F.year("created_date")


def days_to_close() -> Column:
    return days_between(F.col("created_date"), F.col("close_date"))
