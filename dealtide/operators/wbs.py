"""Planned hours of won deals, from the newest work-breakdown batch of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealtide.functions.dates import from_year
from dealtide.functions.deals import DATA_PRACTICES, created_year, in_practices, won
from dealtide.functions.exact import number
from dealtide.plans.changes import of_deals
from dealtide.plans.hours import (
    hour_limbs,
    newest_batch_per_deal,
    newest_batch_per_deal_and_role,
)

# Which roles belong to the data practice.
DATA_ROLE_LIKE = ("%data%",)
DATA_ROLE_NOT_LIKE = ("%contractor%", "%protection%")


def _won_deals(opps: DataFrame, min_year: int, practices: Sequence[str] | None) -> DataFrame:
    return opps.filter(
        won() & in_practices(practices) & from_year(F.col("created_date"), min_year)
    ).select(
        F.col("id").alias("opportunity_id"), "practice", created_year().alias("year_opp_created")
    )


def _role_test(like: Sequence[str], not_like: Sequence[str]) -> Column:
    test = F.lit(True)
    for pattern in like:
        test = test & F.lower("role").like(pattern)
    for pattern in not_like:
        test = test & ~F.lower("role").like(pattern)
    return test


def mean_hours(wbs: DataFrame) -> Column:
    """Mean hours per entry (not per deal) over roll-ups of entries of that plan."""
    totals = [f"sum({limb})" for limb in hour_limbs(wbs)]
    return number(wbs, "hours").rounded(totals, "sum(entries)", 1).alias("avg_hours_per_opp")


def num_deals() -> Column:
    """Deals by their ids, which a source may repeat: folded to (group, id) before they are counted."""
    return F.count_distinct("opportunity_id")


def wbs_hours_by_practice(opps: DataFrame, wbs: DataFrame, *, min_year: int = 2021) -> DataFrame:
    return (
        _won_deals(opps, min_year, None)
        .join(newest_batch_per_deal(wbs), "opportunity_id")
        .groupBy("year_opp_created", "practice")
        .agg(mean_hours(wbs), num_deals().alias("num_opps"))
        .orderBy(F.asc_nulls_last("year_opp_created"), F.asc_nulls_last("practice"))
    )


def wbs_hours_for_practice(
    opps: DataFrame,
    wbs: DataFrame,
    *,
    min_year: int = 2021,
    practices: Sequence[str] = DATA_PRACTICES,
    role_like: Sequence[str] = DATA_ROLE_LIKE,
    role_not_like: Sequence[str] = DATA_ROLE_NOT_LIKE,
) -> DataFrame:
    """Hours of one practice; entries of foreign roles are dropped after the newest batch is found."""
    deals = _won_deals(opps, min_year, practices)
    plans = of_deals(wbs, deals, id="opportunity_id")
    newest = newest_batch_per_deal(plans, _role_test(role_like, role_not_like))
    return (
        deals.join(newest, "opportunity_id")
        .groupBy("year_opp_created")
        .agg(mean_hours(wbs), num_deals().alias("num_opps"))
        .orderBy(F.asc_nulls_last("year_opp_created"))
    )


def wbs_hours_by_role(
    opps: DataFrame,
    wbs: DataFrame,
    *,
    min_year: int = 2021,
    practices: Sequence[str] = DATA_PRACTICES,
    role_like: Sequence[str] = DATA_ROLE_LIKE,
    role_not_like: Sequence[str] = DATA_ROLE_NOT_LIKE,
) -> DataFrame:
    deals = _won_deals(opps, min_year, practices)
    plans = of_deals(wbs, deals, id="opportunity_id")
    newest = newest_batch_per_deal_and_role(plans, _role_test(role_like, role_not_like))
    return (
        deals.join(newest, "opportunity_id")
        .groupBy("year_opp_created", F.col("role").alias("consultant_type"))
        .agg(mean_hours(wbs))
        .orderBy(
            F.asc_nulls_last("year_opp_created"),
            F.desc_nulls_last("avg_hours_per_opp"),
            F.asc_nulls_last("consultant_type"),
        )
    )
