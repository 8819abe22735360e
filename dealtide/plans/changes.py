"""Roll-ups of the field-change history to one row per deal.

All of them aggregate by (deal, change day) before anything is keyed by the deal alone.
The first shuffle is therefore combined on the map side and spread over days, so a deal
that holds a third of the history is never collected in one task: by the time rows meet
on the deal there is at most one per day. Deals join to one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lower-case names of the tracked fields.
STAGE_FIELD = "stagename"
CLOSE_DATE_FIELD = "closedate"

# Stages reported, as lower-case LIKE patterns, with the name of their measure.
STAGES = (
    ("prospecting_lead", "%prospecting%lead%"),
    ("pipeline", "pipeline"),
    ("upside", "upside"),
    ("strong_upside", "strong upside"),
    ("committed", "%commit%"),
)


def of_deals(rows: DataFrame, deals: DataFrame, *, key: str = "opportunity_id", id: str = "id") -> DataFrame:
    """The rows of these deals only. For reports on few deals: what others have is neither folded nor shuffled twice.

    The deals are unique, so a deal with a third of the rows can be split over tasks.
    """
    return rows.join(deals.select(F.col(id).alias(key)), key, "left_semi").select(*rows.columns)


def of_field(history: DataFrame, field: str) -> DataFrame:
    return history.filter(F.lower("field") == field)


def change_days_per_deal(history: DataFrame, field: str) -> DataFrame:
    """opportunity_id, change_days: number of distinct days on which the field changed."""
    return (
        of_field(history, field)
        .groupBy("opportunity_id")
        .agg(F.count_distinct(F.to_date("created_date")).alias("change_days"))
    )


# A day has 24 * 60 * 60 * 1e6 microseconds; times 32 codes this stays far below 2**63.
_MICROS_OF_DAY = """((hour(created_date) * 60L + minute(created_date)) * 60000000L
                     + cast(extract(SECOND FROM created_date) * 1000000 AS bigint))"""


def pick_of_day_sql(fold: str, code: str) -> str:
    """SQL of the code (0 to 31) of the last (``max``) or first (``min``) change of a day.

    Time of day and code share one long. Being a plain number it is folded in a hash
    aggregation before the shuffle, without sorting the history, and is all that is
    shuffled. Changes at the same moment are told apart by code only, so the pick never
    depends on the order of rows. A NULL code is no candidate.
    """
    return f"cast({fold}({_MICROS_OF_DAY} * 32 + ({code})) % 32 AS int)"


def stage_code_sql(stage: str) -> str:
    """One bit per stage pattern that a lower-case value matches."""
    return " + ".join(
        f"if({stage} LIKE '{pattern}', {2**i}, 0)" for i, (_, pattern) in enumerate(STAGES)
    )


def stage_measures_sql() -> list[str]:
    """Over the change days of a deal: changes, and for each stage s: s_changes, s_day_sum."""
    measures = ["count(*) AS changes"]
    for i, (name, _) in enumerate(STAGES):
        hit = f"stages & {2**i} != 0"
        measures.append(f"count_if({hit}) AS {name}_changes")
        measures.append(f"sum(if({hit}, unix_date(change_day), NULL)) AS {name}_day_sum")
    return measures


def stage_changes_per_deal(history: DataFrame) -> DataFrame:
    """Stage changes of each deal, counting only the latest one of a day.

    Columns: opportunity_id, changes, and for each stage s: s_changes, s_day_sum (sum of the
    change days as days since 1970), from which the days left to any close date follow.
    Of changes at the same moment the one furthest down the list of stages counts.
    """
    daily = (
        of_field(history, STAGE_FIELD)
        .select("opportunity_id", "created_date", F.lower("new_value").alias("stage"))
        .groupBy("opportunity_id", F.to_date("created_date").alias("change_day"))
        .agg(F.expr(pick_of_day_sql("max", stage_code_sql("stage"))).alias("stages"))
    )
    return daily.groupBy("opportunity_id").agg(*map(F.expr, stage_measures_sql()))


def close_date_moves_per_deal(history: DataFrame, cuts: tuple[int, int, int]) -> DataFrame:
    """Close-date moves of each deal that has any history, counting the first one of a day.

    Columns: opportunity_id, change_days, and counts of change days by lead (days from the
    change to the old close date) and by shift (days the close date moved): lead_0..lead_3
    and shift_0..shift_3, cut at ``cuts`` with the upper end included. Text that is not a
    date falls in no bucket. Of moves at the same moment the one with the least lead counts,
    then the one with the least shift.

    Changes of other fields share one group per deal (no change day), so they shrink to a
    single row before the shuffle; they only prove that the deal has history.
    """
    day = F.when(F.lower("field") == CLOSE_DATE_FIELD, F.to_date("created_date"))
    dated = history.select(
        "opportunity_id",
        "created_date",
        day.alias("change_day"),
        F.when(day.isNotNull(), F.col("old_value").try_cast("date")).alias("old_close"),
        F.when(day.isNotNull(), F.col("new_value").try_cast("date")).alias("new_close"),
    ).selectExpr(
        "*",
        "datediff(old_close, change_day) AS lead",
        "datediff(new_close, old_close) AS shift",
    )
    buckets = f"{_bucket('lead', cuts)} * 5 + {_bucket('shift', cuts)}"
    daily = dated.groupBy("opportunity_id", "change_day").agg(
        F.expr(pick_of_day_sql("min", f"if(change_day IS NULL, NULL, {buckets})")).alias("move")
    )
    measures = [F.expr("count(move) AS change_days")]
    for i in range(4):
        measures.append(F.expr(f"count_if(move div 5 = {i}) AS lead_{i}"))
        measures.append(F.expr(f"count_if(move % 5 = {i}) AS shift_{i}"))
    return daily.groupBy("opportunity_id").agg(*measures)


def _bucket(days: str, cuts: tuple[int, int, int]) -> str:
    """0 to 3 by upper end, 4 when the days are unknown."""
    first, second, third = cuts
    return (
        f"CASE WHEN {days} <= {first} THEN 0 WHEN {days} <= {second} THEN 1"
        f" WHEN {days} <= {third} THEN 2 WHEN {days} > {third} THEN 3 ELSE 4 END"
    )
