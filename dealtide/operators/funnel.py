"""Funnel and data-quality reports over deals (``opportunity``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.functions.dates import from_year
from dealtide.functions.deals import (
    DATA_PRACTICES,
    closed_once,
    created_year,
    days_to_close,
    in_practices,
    lost,
    won,
)
from dealtide.functions.exact import percent, ratio_sql, rounded_ratio
from dealtide.plans.changes import STAGES, of_deals, stage_changes_per_deal
from dealtide.plans.trim import trim_outliers


def practice_names_like(
    opps: DataFrame,
    column: str = "practice",
    contains: str = "data",
    name: str = "data_practice_names",
) -> DataFrame:
    """Distinct values of a practice column that contain a text, whatever the case."""
    return (
        opps.filter(F.lower(column).contains(contains.lower()))
        .select(F.col(column).alias(name))
        .distinct()
    )


def practice_opps(opps: DataFrame, practices: Sequence[str] = DATA_PRACTICES) -> DataFrame:
    return opps.filter(in_practices(practices)).select(
        "name",
        "practice",
        "created_date",
        "fiscal_quarter",
        "fiscal_year",
        "stage_name",
        "is_won",
        "is_closed",
        "close_date",
        F.col("territory").alias("parent_territory"),
    )


def opps_by_practice(opps: DataFrame) -> DataFrame:
    return (
        opps.groupBy("practice")
        .agg(F.count("*").alias("num_opps"))
        .orderBy(F.desc_nulls_last("num_opps"), F.asc_nulls_last("practice"))
    )


def null_practice_share_by_creator(
    opps: DataFrame, *, min_year: int = 2020, min_count: int = 10, top: int = 10
) -> DataFrame:
    """Creators with the most deals without practice in a year, and their share of that year."""
    # The join would demand a known year of one branch only; demanded here, both branches
    # are alike and share one aggregation.
    per_creator = (
        _without_practice(opps, min_year)
        .filter(created_year().isNotNull())
        .groupBy(
            F.col("created_by_id").alias("opps_created_by_id"),
            created_year().alias("opps_year_created"),
        )
        .agg(F.count("*").alias("num_opp_w_practice_null"))
    )
    # One row per calendar year, so the broadcast has a fixed size.
    per_year = per_creator.groupBy("opps_year_created").agg(
        F.sum("num_opp_w_practice_null").alias("yearly_total_num_opp_w_practice_null")
    )
    return (
        per_creator.filter(F.col("num_opp_w_practice_null") >= min_count)
        .join(F.broadcast(per_year), "opps_year_created", "left")
        .orderBy(
            F.desc("num_opp_w_practice_null"),
            F.asc_nulls_last("opps_created_by_id"),
            F.asc("opps_year_created"),
        )
        .limit(top)
        .select(
            "opps_created_by_id",
            "opps_year_created",
            "num_opp_w_practice_null",
            "yearly_total_num_opp_w_practice_null",
            percent("num_opp_w_practice_null", "yearly_total_num_opp_w_practice_null").alias(
                "yearly_percent_share_of_nulls_created"
            ),
        )
    )


def null_practice_excluding_bulk_creators(
    opps: DataFrame, *, min_year: int = 2020, min_per_day: int = 3
) -> DataFrame:
    """Deals without practice that were not made by a bulk creator, and the bulk creators.

    A bulk creator made ``min_per_day`` such deals on some day. Follows ``NOT IN``: deals
    without a creator count only if there is no bulk creator at all, and if the unknown
    creator is itself a bulk creator no deal counts.
    """
    per_day = (
        _without_practice(opps, min_year)
        .groupBy("created_by_id", F.to_date("created_date").alias("day"))
        .agg(F.count("*").alias("n"))
    )
    per_creator = per_day.groupBy("created_by_id").agg(
        F.sum("n").alias("n"), (F.max("n") >= min_per_day).alias("bulk")
    )
    known = F.col("created_by_id").isNotNull()
    totals = per_creator.agg(
        F.sum("n").alias("every"),
        F.sum(F.when(known & ~F.col("bulk"), F.col("n"))).alias("others"),
        F.count_if("bulk").alias("bulk"),
        F.count_if(F.col("bulk") & known).alias("bulk_known"),
    )
    remaining = (
        F.when(F.col("bulk") == 0, F.col("every"))
        .when(F.col("bulk") == F.col("bulk_known"), F.col("others"))
    )
    return totals.select(
        F.coalesce(remaining, F.lit(0)).alias("num_opps_w_practice_field_nulls"),
        F.col("bulk_known").alias("num_creator_ids_omitted"),
    )


def null_practice_by_year(opps: DataFrame, *, min_year: int = 2015) -> DataFrame:
    return (
        _without_practice(opps, min_year)
        .groupBy(created_year().alias("year_opp_created"))
        .agg(F.count("*").alias("num_practice_field_nulls_per_year"))
        .select("num_practice_field_nulls_per_year", "year_opp_created")
        .orderBy(F.asc_nulls_last("year_opp_created"))
    )


def _without_practice(opps: DataFrame, min_year: int) -> DataFrame:
    return opps.filter(F.col("practice").isNull() & from_year(F.col("created_date"), min_year))


def win_rate_by_year(
    opps: DataFrame, *, min_year: int | None = 2020, practices: Sequence[str] | None = None
) -> DataFrame:
    """Won deals as a percentage of closed deals by creation year.

    Duplicates are left out of the closed deals only. A year without a win shows NULL, and so
    do, without a year floor, the deals of an unknown year.
    """
    known_year = F.col("year_opp_created").isNotNull()
    return (
        opps.filter(
            F.col("is_closed")
            & in_practices(practices)
            & from_year(F.col("created_date"), min_year)
        )
        .groupBy(created_year().alias("year_opp_created"))
        .agg(F.count_if(won()).alias("won"), F.count_if(closed_once()).alias("closed"))
        .filter(F.col("closed") > 0)
        .select(
            "year_opp_created",
            F.when(known_year, percent("won", "closed")).alias("opp_to_win_percent"),
        )
        .orderBy(F.asc_nulls_last("year_opp_created"))
    )


def win_rate_by_year_for_practice(
    opps: DataFrame, *, practices: Sequence[str] = DATA_PRACTICES
) -> DataFrame:
    return win_rate_by_year(opps, min_year=None, practices=practices)


def days_to_close_stats(
    opps: DataFrame,
    *,
    practices: Sequence[str] | None = DATA_PRACTICES,
    min_days: int = 1,
    k: float = 3,
) -> DataFrame:
    """Median and mean days to close of won deals, quick wins and outliers left out."""
    days = (
        opps.filter(won() & in_practices(practices))
        .groupBy(days_to_close().alias("days"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("days") > min_days)
    )
    return trim_outliers(days, "days", "n", k).agg(
        F.percentile("days", 0.5, F.col("n")).alias("median_days_to_close"),
        rounded_ratio("sum(days * n)", "sum(n)", 1).alias("avg_days_to_close"),
    )


def stage_day_sums(
    deals: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    k: float,
    *,
    few: bool = False,
    label: Callable[[DataFrame], DataFrame] = lambda folded: folded,
) -> DataFrame:
    """Stage measures per ``keys`` after trimming deals by their days to close.

    ``few``: the deals are a small part of all, so the history is limited to them before it is folded.
    ``label``: puts labels for the values of keys, once the deals are folded by them.

    ``deals``: id, close_date, days (to close) and the keys. The standard
    deviation is taken over change days, not over deals, and all change days of a deal share
    its days to close, so trimming works on one row per (keys, days).
    """
    if few:
        history = of_deals(history, deals)
    # A change counts once, however often its deal is listed; of copies that differ the least one is taken.
    others = [name for name in deals.columns if name != "id"]
    deals = deals.groupBy("id").agg(F.min(F.struct(*others)).alias("deal")).select("id", "deal.*")
    rollup = stage_changes_per_deal(history).withColumnRenamed("opportunity_id", "id")
    histogram = deals.join(rollup, "id").groupBy(*keys, "days").agg(*map(F.expr, stage_totals_sql()))
    kept = trim_outliers(label(histogram), "days", "changes", k)
    return kept.groupBy(*keys).agg(F.sum("num_opps").alias("num_opps"), *map(F.expr, stage_means_sql()))


def stage_totals_sql() -> list[str]:
    """Over deals with their changes: deals, change days, and for each stage its changes and the days left to close."""
    totals = ["count(*) AS num_opps", "sum(changes) AS changes"]
    for name, _ in STAGES:
        left = f"{name}_changes * unix_date(close_date) - {name}_day_sum"
        totals.append(f"sum({name}_changes) AS {name}_changes")
        totals.append(f"sum(coalesce({left}, 0)) AS {name}_days")
    return totals


def stage_means_sql() -> list[str]:
    return [
        f"{ratio_sql(f'sum({name}_days)', f'sum({name}_changes)', 1)} AS {name}_avg_days_till_close"
        for name, _ in STAGES
    ]


def stage_days_to_close_by_year(
    opps: DataFrame,
    history: DataFrame,
    *,
    min_year: int = 2021,
    min_days: int = 1,
    k: float = 3,
    practices: Sequence[str] | None = None,
) -> DataFrame:
    """Mean days left to close when a won deal entered each stage, by creation year."""
    deals = (
        opps.filter(won() & in_practices(practices) & from_year(F.col("created_date"), min_year))
        .select(
            "id",
            "close_date",
            created_year().alias("year_opp_created"),
            days_to_close().alias("days"),
        )
        .filter(F.col("days") > min_days)
    )
    return (
        stage_day_sums(deals, history, ["year_opp_created"], k, few=practices is not None)
        .drop("num_opps")
        .orderBy(F.asc_nulls_last("year_opp_created"))
    )


def stage_days_to_close_by_year_for_practice(
    opps: DataFrame,
    history: DataFrame,
    *,
    practices: Sequence[str] = DATA_PRACTICES,
    min_year: int = 2021,
    min_days: int = 1,
    k: float = 3,
) -> DataFrame:
    return stage_days_to_close_by_year(
        opps, history, min_year=min_year, min_days=min_days, k=k, practices=practices
    )


def quick_wins_by_year(
    opps: DataFrame, *, practices: Sequence[str] | None = DATA_PRACTICES, max_days: int = 1
) -> DataFrame:
    """Deals won within ``max_days`` of their creation, by creation year."""
    return (
        opps.filter(won() & in_practices(practices) & days_to_close().between(0, max_days))
        .groupBy(created_year().alias("year_opp_created"))
        .agg(F.count("*").alias("num_opps_0_or_1days_create_to_close"))
        .orderBy(F.asc_nulls_last("year_opp_created"))
    )


def loss_reason_rate(opps: DataFrame, *, min_year: int = 2020) -> DataFrame:
    """Percentage of lost deals with a reason, by creation year; NULL if none has one."""
    return (
        opps.filter(lost() & from_year(F.col("created_date"), min_year))
        .groupBy(created_year().alias("year_opp_created"))
        .agg(
            percent("count(reason_code)", "count(*)").alias(
                "reason_for_opp_closing_provided_percent"
            )
        )
        .orderBy(F.asc_nulls_last("year_opp_created"))
    )
