"""Milestones of resource requests: when the person was set, when holds ended, the last change.

Only the moments matter, so each milestone is a conditional max or min. They are folded on
the map side before any shuffle; a request with a huge history arrives as a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealtide.functions.dates import days_between

# Lower-case names of the tracked fields.
STAFFER_FIELD = "pse__staffer_resource__c"
HELD_FIELD = "pse__resource_held__c"


def person_assigned() -> Column:
    """The change put in a person: ids contain a 0, names of people do not."""
    return (F.lower("field") == STAFFER_FIELD) & ~F.col("new_value").contains("0")


def hold_changed() -> Column:
    return F.lower("field") == HELD_FIELD


def hold_ended() -> Column:
    """The hold flag left true; text that is not a boolean does not count."""
    return F.when(hold_changed(), F.col("old_value").try_cast("boolean"))


def milestones() -> list[Column]:
    at = F.col("created_date")
    return [
        F.max(F.when(person_assigned(), at)).alias("last_change"),
        F.min(F.when(hold_ended(), at)).alias("first_hold"),
        F.max(F.when(hold_ended(), at)).alias("last_hold"),
        F.max(at).alias("final_change"),
    ]


def milestones_per_request(history: DataFrame) -> DataFrame:
    return history.groupBy(F.col("parent_id").alias("id")).agg(*milestones())


def days_held_since_change(last_change: Column, last_hold: Column, final: Column) -> Column:
    """From the last assignment to the last end of a hold, or to the final change without one.

    A hold that ended before the assignment gives a negative number; it is not replaced.
    """
    return F.coalesce(days_between(last_change, last_hold), days_between(last_change, final))


def days_held_since_request(requested: Column, first_hold: Column, final: Column) -> Column:
    """From the request to the first end of a hold, or to the final change without one."""
    return F.coalesce(days_between(requested, first_hold), days_between(requested, final))
