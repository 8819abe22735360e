"""Dashboard views: deals closed within a window that moves with the report date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealtide.functions.dates import within_quarters, within_years
from dealtide.functions.deals import closed_once, days_to_close, won
from dealtide.functions.exact import percent, rounded_ratio
from dealtide.functions.labels import DEAL_PRACTICES, Rules, with_deal_practice
from dealtide.operators.funnel import stage_day_sums
from dealtide.operators.wbs import mean_hours, num_deals
from dealtide.plans.changes import STAGES
from dealtide.plans.hours import newest_batch_per_deal
from dealtide.plans.trim import trim_outliers

_STAGE_AVERAGES = [f"{name}_avg_days_till_close" for name, _ in STAGES]


def _closed_within(opps: DataFrame, test: Column, columns: Sequence[str]) -> DataFrame:
    """The given columns of the deals that pass, with practice, closing year and quarter.

    The practice is as entered: reports fold by it first and label what is left, so that the rules run once for each
    practice of a group.
    """
    return opps.filter(test).selectExpr(
        "practice",
        "year(close_date) AS year_opp_closed",
        "quarter(close_date) AS quarter_opp_closed",
        *columns,
    )


def _stage_days(
    opps: DataFrame,
    history: DataFrame,
    window: Column,
    keys: Sequence[str],
    min_days: int,
    k: float,
    rules: Rules,
    few: bool = False,
) -> DataFrame:
    test = won() & window & (days_to_close() > min_days)
    columns = ["id", "close_date", "datediff(close_date, created_date) AS days"]
    deals = _closed_within(opps, test, columns).select("id", "close_date", "days", *keys)
    return stage_day_sums(
        deals, history, keys, k, few=few, label=lambda folded: with_deal_practice(folded, rules)
    )


def stage_days_by_practice_quarter(
    opps: DataFrame,
    history: DataFrame,
    *,
    as_of: dt.date | None = None,
    quarters: int = 3,
    min_days: int = 1,
    k: float = 3,
    rules: Rules = DEAL_PRACTICES,
) -> DataFrame:
    """Mean days left to close per stage, by practice and quarter of closing."""
    window = within_quarters(F.col("close_date"), as_of, quarters)
    keys = ["practice", "year_opp_closed", "quarter_opp_closed"]
    return (
        _stage_days(opps, history, window, keys, min_days, k, rules, few=True)
        .select(*keys, "num_opps", *_STAGE_AVERAGES)
        .orderBy(*[F.asc_nulls_last(key) for key in keys])
    )


def stage_days_by_practice_year(
    opps: DataFrame,
    history: DataFrame,
    *,
    as_of: dt.date | None = None,
    years: int = 2,
    min_days: int = 1,
    k: float = 3,
    rules: Rules = DEAL_PRACTICES,
) -> DataFrame:
    """Mean days left to close per stage, by practice and year of closing."""
    window = within_years(F.col("close_date"), as_of, years)
    keys = ["practice", "year_opp_closed"]
    return (
        _stage_days(opps, history, window, keys, min_days, k, rules)
        .select("year_opp_closed", "practice", "num_opps", *_STAGE_AVERAGES)
        .orderBy(*[F.asc_nulls_last(key) for key in keys])
    )


def win_rate_by_practice_quarter(
    opps: DataFrame,
    *,
    as_of: dt.date | None = None,
    years: int = 2,
    rules: Rules = DEAL_PRACTICES,
) -> DataFrame:
    """Won, closed and lost deals by practice and quarter of closing.

    Duplicates are left out of the closed deals only. A group without a win keeps its closed
    count, but its year, quarter, won, lost and percent are NULL.
    """
    keys = ["practice", "year_opp_closed", "quarter_opp_closed"]
    folded = (
        _closed_within(
            opps,
            F.col("is_closed") & within_years(F.col("close_date"), as_of, years),
            ["is_closed", "is_won", "stage_name"],
        )
        .groupBy(*keys)
        .agg(F.count_if(won()).alias("won"), F.count_if(closed_once()).alias("closed"))
    )
    counts = (
        with_deal_practice(folded, rules)
        .groupBy(*keys)
        .agg(F.sum("won").alias("won"), F.sum("closed").alias("closed"))
        .filter(F.col("closed") > 0)
    )
    any_won = F.col("won") > 0
    return counts.select(
        "practice",
        F.when(any_won, F.col("year_opp_closed")).alias("year_opp_closed"),
        F.when(any_won, F.col("quarter_opp_closed")).alias("quarter_opp_closed"),
        F.when(any_won, F.col("won")).alias("won_opps"),
        F.col("closed").alias("all_closed_opps"),
        F.when(any_won, F.col("closed") - F.col("won")).alias("lost_opps"),
        percent("won", "closed").alias("opp_win_percent"),
    ).orderBy(
        F.asc_nulls_last("practice"),
        F.asc_nulls_last("year_opp_closed"),
        F.asc_nulls_last("quarter_opp_closed"),
    )


def days_to_close_by_practice_year(
    opps: DataFrame,
    *,
    as_of: dt.date | None = None,
    years: int = 2,
    min_days: int = 1,
    k: float = 3,
    rules: Rules = DEAL_PRACTICES,
) -> DataFrame:
    """Median and mean days to close of won deals; outliers are judged over all practices."""
    histogram = (
        _closed_within(
            opps,
            won() & within_years(F.col("close_date"), as_of, years) & (days_to_close() > min_days),
            ["datediff(close_date, created_date) AS days"],
        )
        .groupBy("practice", "year_opp_closed", "days")
        .agg(F.count("*").alias("n"))
    )
    return (
        trim_outliers(with_deal_practice(histogram, rules), "days", "n", k)
        .groupBy("practice", "year_opp_closed")
        .agg(
            F.sum("n").alias("num_opps_won"),
            F.percentile("days", 0.5, F.col("n")).alias("median_days_to_close"),
            rounded_ratio("sum(days * n)", "sum(n)", 1).alias("avg_days_to_close"),
        )
        .orderBy(F.asc_nulls_last("practice"), F.asc_nulls_last("year_opp_closed"))
    )


def wbs_hours_by_practice_quarter(
    opps: DataFrame,
    wbs: DataFrame,
    *,
    as_of: dt.date | None = None,
    years: int = 2,
    drop: Sequence[str] = ("Managed Services",),
    rules: Rules = DEAL_PRACTICES,
) -> DataFrame:
    """Mean planned hours and deals with a plan, by practice and quarter of closing."""
    test = won() & within_years(F.col("close_date"), as_of, years)
    deals = with_deal_practice(_closed_within(opps, test, ["id AS opportunity_id"]), rules).filter(
        ~F.lower("practice").isin([label.lower() for label in drop])
    )
    return (
        deals.join(newest_batch_per_deal(wbs), "opportunity_id")
        .groupBy("year_opp_closed", "quarter_opp_closed", "practice")
        .agg(mean_hours(wbs), num_deals().alias("num_opps_w_wbs"))
        .orderBy(
            F.asc_nulls_last("practice"),
            F.asc_nulls_last("year_opp_closed"),
            F.asc_nulls_last("quarter_opp_closed"),
        )
    )


def wbs_hours_and_win_rate(hours: DataFrame, win_rate: DataFrame) -> DataFrame:
    """The two quarterly views side by side; groups without a closing quarter are left out."""
    keys = ["practice", "year_opp_closed", "quarter_opp_closed"]
    return (
        hours.join(win_rate, keys, "full")
        .filter(F.col("year_opp_closed").isNotNull() & F.col("quarter_opp_closed").isNotNull())
        .select(
            *keys,
            "avg_hours_per_opp",
            "num_opps_w_wbs",
            "won_opps",
            "all_closed_opps",
            "lost_opps",
            "opp_win_percent",
        )
        .orderBy(*[F.asc_nulls_last(key) for key in keys])
    )
