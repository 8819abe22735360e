"""How often and how far tracked fields of won deals change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.functions.dates import from_year
from dealtide.functions.deals import DATA_PRACTICES, created_year, in_practices, won
from dealtide.functions.exact import rounded_ratio
from dealtide.plans.changes import (
    CLOSE_DATE_FIELD,
    STAGE_FIELD,
    change_days_per_deal,
    close_date_moves_per_deal,
    of_deals,
)


def _won_deals(opps: DataFrame, min_year: int, practices: Sequence[str] | None) -> DataFrame:
    """id, year_opp_created (of copies that differ, the earliest), copies: each deal once, however often it is listed."""
    return (
        opps.filter(won() & in_practices(practices) & from_year(F.col("created_date"), min_year))
        .groupBy("id")
        .agg(F.min(created_year()).alias("year_opp_created"), F.count("*").alias("copies"))
    )


def field_changes_per_opp(
    opps: DataFrame,
    history: DataFrame,
    *,
    field: str,
    min_year: int = 2021,
    practices: Sequence[str] | None = None,
    name: str | None = None,
) -> DataFrame:
    """Mean number of change days of a field per won deal, by creation year.

    Deals that never changed count in the denominator, and so do copies of a deal; years without any change are
    left out.
    """
    name = name or f"avg_{field}_changes_per_opp"
    deals = _won_deals(opps, min_year, practices)
    if practices is not None:
        history = of_deals(history, deals)
    changes = change_days_per_deal(history, field).withColumnRenamed("opportunity_id", "id")
    return (
        deals.join(changes, "id", "left")
        .groupBy("year_opp_created")
        .agg(
            F.sum("change_days").alias("change_days"),
            F.sum(F.when(F.col("id").isNotNull(), F.col("copies"))).alias("deals"),
        )
        .filter(F.col("change_days").isNotNull())
        .select("year_opp_created", rounded_ratio("change_days", "deals", 1).alias(name))
        .orderBy(F.asc_nulls_last("year_opp_created"))
    )


def closedate_changes_per_opp(
    opps: DataFrame, history: DataFrame, *, min_year: int = 2021
) -> DataFrame:
    return field_changes_per_opp(opps, history, field=CLOSE_DATE_FIELD, min_year=min_year)


def closedate_changes_per_opp_for_practice(
    opps: DataFrame,
    history: DataFrame,
    *,
    practices: Sequence[str] = DATA_PRACTICES,
    min_year: int = 2021,
) -> DataFrame:
    return field_changes_per_opp(
        opps, history, field=CLOSE_DATE_FIELD, min_year=min_year, practices=practices
    )


def stage_changes_per_opp(
    opps: DataFrame, history: DataFrame, *, min_year: int = 2021
) -> DataFrame:
    return field_changes_per_opp(opps, history, field=STAGE_FIELD, min_year=min_year)


def stage_changes_per_opp_for_practice(
    opps: DataFrame,
    history: DataFrame,
    *,
    practices: Sequence[str] = DATA_PRACTICES,
    min_year: int = 2021,
) -> DataFrame:
    return field_changes_per_opp(
        opps,
        history,
        field=STAGE_FIELD,
        min_year=min_year,
        practices=practices,
        name="avg_stagename_changes_per_data_opp",
    )


# Output names of the lead and shift buckets, in order.
LEAD_NAMES = (
    "num_opps_closedate_changed_on_or_after_close",
    "num_opps_closedate_changed_within_oneweek_from_close",
    "num_opps_closedate_changed_within_onemonth_from_close",
    "num_opps_closedate_changed_more_than_onemonth_from_close",
)
SHIFT_NAMES = (
    "num_opps_closedate_pulled_ahead",
    "num_opps_closedate_changedby_oneweek_orless",
    "num_opps_closedate_changedby_onemonth_orless",
    "num_opps_closedate_changedby_morethan_onemonth",
)


def closedate_movement(
    opps: DataFrame,
    history: DataFrame,
    *,
    min_year: int = 2021,
    cuts: tuple[int, int, int] = (0, 7, 30),
    practices: Sequence[str] | None = None,
) -> DataFrame:
    """How late and how far close dates of won deals were moved, by creation year.

    Looks at won deals with any history. The buckets count change days (one change per deal
    and day). Only years that have both moved and unmoved deals are shown.
    """
    deals = _won_deals(opps, min_year, practices)
    if practices is not None:
        history = of_deals(history, deals)
    moves = close_date_moves_per_deal(history, cuts).withColumnRenamed("opportunity_id", "id")
    buckets = [f"{kind}_{i}" for kind in ("lead", "shift") for i in range(4)]
    moved = F.col("change_days") > 0
    per_year = (
        deals.join(moves, "id")
        .groupBy("year_opp_created")
        .agg(
            F.count_if(moved).alias("moved"),
            F.count_if(~moved).alias("unmoved"),
            *[F.sum(b).alias(b) for b in buckets],
        )
        .filter((F.col("moved") > 0) & (F.col("unmoved") > 0))
    )
    return per_year.select(
        "year_opp_created",
        (F.col("moved") + F.col("unmoved")).alias("num_unique_opps"),
        F.col("unmoved").alias("num_opps_w_unchanged_closedate"),
        *[F.col(b).alias(n) for b, n in zip(buckets, LEAD_NAMES + SHIFT_NAMES, strict=True)],
    ).orderBy(F.asc_nulls_last("year_opp_created"))


def closedate_movement_for_practice(
    opps: DataFrame,
    history: DataFrame,
    *,
    practices: Sequence[str] = DATA_PRACTICES,
    min_year: int = 2021,
    cuts: tuple[int, int, int] = (0, 7, 30),
) -> DataFrame:
    return closedate_movement(opps, history, min_year=min_year, cuts=cuts, practices=practices)
