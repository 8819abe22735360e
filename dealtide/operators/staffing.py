"""People held for deals that were lost."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealtide.functions.dates import as_of_date, from_year, quarter_label
from dealtide.functions.deals import lost
from dealtide.plans.changes import of_deals
from dealtide.plans.holds import (
    days_held_since_change,
    days_held_since_request,
    hold_changed,
    milestones_per_request,
    person_assigned,
)
from dealtide.plans.numbering import numbered


def real_resources(requests: DataFrame, actuals: DataFrame) -> DataFrame:
    """Requests whose resource is a known person, not a placeholder."""
    return requests.join(actuals.select("resource_id"), "resource_id", "left_semi").select(
        *requests.columns
    )


def consultant_names(actuals: DataFrame) -> DataFrame:
    """resource_id, consultant_name: one name per resource, the part before " - "."""
    name = F.split_part(F.min("name"), F.lit(" - "), F.lit(1))
    return actuals.groupBy("resource_id").agg(name.alias("consultant_name"))


def _lost_requests(requests: DataFrame, opps: DataFrame, min_year: int) -> DataFrame:
    """Requests on a lost deal, with the close date of the deal."""
    deals = opps.filter(lost() & from_year(F.col("close_date"), min_year)).select(
        F.col("id").alias("opportunity_id"), "close_date", "job_id"
    )
    return requests.join(deals, "opportunity_id")


def _held_requests(
    requests: DataFrame,
    opps: DataFrame,
    history: DataFrame,
    actuals: DataFrame,
    as_of: dt.date | None,
    min_year: int,
    min_held_days: int,
    few: bool = False,
) -> DataFrame:
    """Lost requests whose person was held for at least ``min_held_days``, one row each.

    A request without history was never held. ``few``: the requests are a small part of all, so the history is
    limited to them before it is folded.
    """
    opps = opps.filter(F.col("close_date") <= as_of_date(as_of))
    held_days = F.when(
        F.col("last_change").isNotNull(),
        days_held_since_change(F.col("last_change"), F.col("last_hold"), F.col("final_change")),
    ).otherwise(
        days_held_since_request(F.col("created_date"), F.col("first_hold"), F.col("final_change"))
    )
    chosen = real_resources(_lost_requests(requests, opps, min_year), actuals)
    if few:
        history = of_deals(history, chosen, key="parent_id")
    return (
        chosen.join(milestones_per_request(history), "id")
        .filter(held_days >= min_held_days)
        .select(
            "id",
            "opportunity_id",
            "practice",
            F.col("role").alias("resource_role"),
            F.year("close_date").alias("year_opp_closed"),
            quarter_label(F.col("close_date")).alias("qtr_opp_closed"),
        )
    )


def _count_held(held: DataFrame, *keys: str) -> DataFrame:
    return (
        held.groupBy(*keys)
        .agg(
            F.count_distinct("id").alias("num_resources_held_and_opp_lost"),
            F.count_distinct("opportunity_id").alias("num_opps_lost_w_resources_held"),
        )
        .orderBy(*[F.asc_nulls_last(key) for key in keys])
    )


def held_for_lost_by_quarter(
    requests: DataFrame,
    opps: DataFrame,
    history: DataFrame,
    actuals: DataFrame,
    *,
    as_of: dt.date | None = None,
    min_year: int = 2021,
    min_held_days: int = 10,
) -> DataFrame:
    """Requests held and deals lost, by quarter of closing."""
    held = _held_requests(requests, opps, history, actuals, as_of, min_year, min_held_days)
    return _count_held(held, "year_opp_closed", "qtr_opp_closed")


def held_for_lost_by_practice_quarter(
    requests: DataFrame,
    opps: DataFrame,
    history: DataFrame,
    actuals: DataFrame,
    *,
    as_of: dt.date | None = None,
    min_year: int = 2021,
    min_held_days: int = 10,
) -> DataFrame:
    """As by quarter, also by practice of the request."""
    held = _held_requests(requests, opps, history, actuals, as_of, min_year, min_held_days)
    return _count_held(held, "practice", "year_opp_closed", "qtr_opp_closed")


def held_for_lost_by_role(
    requests: DataFrame,
    opps: DataFrame,
    history: DataFrame,
    actuals: DataFrame,
    *,
    as_of: dt.date | None = None,
    min_year: int = 2021,
    min_held_days: int = 10,
    practice: str = "data",
) -> DataFrame:
    """Requests held and deals lost of one practice (exactly, in lower case), by role."""
    requests = requests.filter(F.lower("practice") == practice)
    held = _held_requests(
        requests, opps, history, actuals, as_of, min_year, min_held_days, few=True
    )
    return _count_held(held, "resource_role")


def resource_request_audit(
    requests: DataFrame,
    opps: DataFrame,
    history: DataFrame,
    actuals: DataFrame,
    *,
    min_year: int = 2021,
    min_held_days: int = 10,
    ordered: bool = True,
) -> DataFrame:
    """The history of lost requests with the hold arithmetic at each step.

    Shows assignments of a person, changes of the hold flag, and everything at the final
    moment. A milestone is known from its own moment on, so the day counts are NULL before it.
    Changes without a time come last within their request. ``ordered``: sort the result, a shuffle of its rows.

    Events are numbered by sums over days, seconds and events (see `numbered`), so a request with a third of the
    history, in one hour or at one moment, is spread over many tasks. All runs when the result is read.
    """
    # The names hold every real resource once, so this also drops requests for placeholders.
    lost_requests = (
        _lost_requests(requests, opps, min_year)
        .join(consultant_names(actuals), "resource_id")
        .withColumnRenamed("created_date", "requested")
    )
    # Most history belongs to other requests; it goes before the rest is numbered.
    events = of_deals(history, lost_requests, key="parent_id")
    numbers = numbered(
        events.withColumnRenamed("parent_id", "id").withColumnRenamed("created_date", "at"),
        "id",
        "at",
        ["field", "old_value", "new_value"],
        "event",
    )
    # A request that is listed several times, or whose deal is, shows each event as often.
    copies = Window.partitionBy("id")
    listed = lost_requests.withColumns(
        {
            "copies": F.count("*").over(copies),
            "copy": F.row_number().over(copies.orderBy("close_date", "job_id", "practice", "requested")),
        }
    )
    numbers = numbers.join(listed, "id").withColumn(
        "order_of_events", (F.col("event") - 1) * F.col("copies") + F.col("copy")
    )
    marks = milestones_per_request(events)
    known_events = numbers.join(marks, "id")

    def known(mark: str):
        return F.when(F.col("at") >= F.col(mark), F.col(mark))

    final = F.when(F.col("at") == F.col("final_change"), F.col("at"))
    changed = F.col("last_change").isNotNull()
    since_change = days_held_since_change(known("last_change"), known("last_hold"), final)
    since_request = days_held_since_request(F.col("requested"), known("first_hold"), final)
    held = F.when(changed, since_change).otherwise(since_request) >= min_held_days
    shown = (
        (person_assigned() | hold_changed()) | (F.col("at") == F.col("final_change"))
    )
    found = known_events.filter(shown)
    return (
        (found.orderBy("close_date", "id", "order_of_events") if ordered else found)
        .select(
            "practice",
            "job_id",
            F.col("id").alias("resource_req_id"),
            F.col("requested").alias("resource_req_date"),
            "consultant_name",
            "order_of_events",
            F.col("at").alias("resource_req_change_date"),
            "field",
            "old_value",
            "new_value",
            F.when(~changed, since_request).alias("num_days_held__resource_never_changed"),
            F.when(changed, since_change).alias("num_days_held__resource_changed"),
            final.alias("final_change_to_resource_request_date"),
            F.coalesce(held, F.lit(False)).alias("resource_held_and_opp_lost"),
            F.year("close_date").alias("year_opp_closed"),
            quarter_label(F.col("close_date")).alias("qtr_opp_closed"),
        )
    )
